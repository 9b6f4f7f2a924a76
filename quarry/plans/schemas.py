"""Catalog tables: the one place where their columns are named."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

TABLES = {
    "company": "cik bigint, cik_name string, ticker string, exchange string, sic_code string, figi string, cusip string, isin string, is_active boolean",
    "company_info": "cik bigint, name string, is_company boolean, category string, description string, entity_type string, ein string, industry string, sic string, sic_description string, state_of_incorporation string, state_of_incorporation_description string, fiscal_year_end string, mailing_address string, business_address string, phone string, tickers array<string>, exchanges array<string>, former_names string, flags string, insider_transaction_for_owner_exists smallint, insider_transaction_for_issuer_exists smallint, website string, investor_website string, asof date",
    "form_index": "form string, description string",
    "bulk_filing_index": "filename string, year int, quarter int, processed date, error boolean, ignored boolean",
    "filing_index": "accession_number string, form string, company string, cik bigint, date_filed date, filename string",
    "filing": "accession_number string, form string, date_filed date, cik bigint, company string, sha1 string, path string, document_count int, processed_document_count int, is_processed boolean, is_error boolean, documents_index string, acceptance_datetime timestamp, date_downloaded date, document_url string, homepage_url string, text_url string, year smallint, qtr smallint, month smallint, day smallint, markdown_path string",
    "fact_index": "fact string, label string, description string",
    "company_fact": "id string, cik string, accession_number string, fact string, namespace string, unit string, value double, end_date date, datefiled date, fiscal_year int, fiscal_period string, form string, frame string",
    "filing_document": "id bigint, filing string, type string, sequence int, file_name string, content_type string, description string, sha1 string, start_pos int, end_pos int, is_processed boolean, is_error boolean",
    "search_query": "id bigint, form_type string, date_created timestamp, date_completed timestamp",
    "search_query_term": "id bigint, search_query bigint, term string",
    "search_query_result": "id bigint, search_query bigint, filing_document bigint, term bigint, count int",
    "chunk": "id string, cik string, accession_number string, form_type string, date_filed string, section string, content string, start_pos bigint, end_pos bigint, embedding array<float>",
}
#: Unique keys by table.
KEYS = {
    "company": ["cik"], "company_info": ["cik"], "form_index": ["form"], "bulk_filing_index": ["filename"], "filing_index": ["accession_number"],
    "filing": ["accession_number"], "fact_index": ["fact"], "company_fact": ["id"], "filing_document": ["filing", "sequence"],
    "search_query": ["id"], "search_query_term": ["search_query", "term"], "search_query_result": ["id"], "chunk": ["id"],
}


def empty(spark: SparkSession, name: str):
    return spark.createDataFrame([], TABLES[name])


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])
