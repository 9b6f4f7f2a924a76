"""Envelopes, ownership forms, holdings and HTML."""

import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators import chunking
from quarry.parsers import envelope, holdings, html, ownership, registry

ENVELOPE = """<SEC-HEADER>
ACCESSION NUMBER:\t\t0000009876-22-000005
CONFORMED SUBMISSION TYPE:\t8-K
PUBLIC DOCUMENT COUNT:\t\t2
CONFORMED PERIOD OF REPORT:\t20240131
FILED AS OF DATE:\t\t20240201

FILER:

\tCOMPANY DATA:
\t\tCOMPANY CONFORMED NAME:\t\tLarch Savings Co
\t\tCENTRAL INDEX KEY:\t\t5150
\t\tSTANDARD INDUSTRIAL CLASSIFICATION:\tPAPER MILLS [2621]
\t\tSTATE OF INCORPORATION:\t\tME
</SEC-HEADER>
<DOCUMENT>
<TYPE>8-K
<SEQUENCE>1
<FILENAME>a.htm
<TEXT>
<HTML><body><p>Hello</p></body></HTML>
</TEXT>
</DOCUMENT>
<DOCUMENT>
<TYPE>EX-99
<SEQUENCE>2
<FILENAME>b.txt
<DESCRIPTION>PRESS RELEASE
<TEXT>
plain words
</TEXT>
</DOCUMENT>
"""

#: Two owners, rows of both tables, namespaces, a stray ampersand and a reference
#: that no note answers.
FORM = """text before <ownershipDocument xmlns="urn:form"><schemaVersion>X0508</schemaVersion><documentType>5</documentType><periodOfReport>2022-11-30</periodOfReport>
<issuer><issuerCik>77</issuerCik><issuerName>Willow & Reed</issuerName><issuerTradingSymbol>WREE</issuerTradingSymbol></issuer>
<reportingOwner><reportingOwnerId><rptOwnerCik>0000000905</rptOwnerCik><rptOwnerName>Ash K</rptOwnerName></reportingOwnerId>
<reportingOwnerRelationship><isOfficer>1</isOfficer><officerTitle>Treasurer</officerTitle></reportingOwnerRelationship></reportingOwner>
<reportingOwner><reportingOwnerId><rptOwnerCik>906</rptOwnerCik><rptOwnerName>Birch Trust</rptOwnerName></reportingOwnerId>
<reportingOwnerRelationship><isTenPercentOwner>true</isTenPercentOwner></reportingOwnerRelationship></reportingOwner>
<nonDerivativeTable><nonDerivativeHolding><securityTitle><value>Class B</value></securityTitle><postTransactionAmounts><sharesOwnedFollowingTransaction><value>7</value></sharesOwnedFollowingTransaction></postTransactionAmounts></nonDerivativeHolding>
<nonDerivativeTransaction><securityTitle><value>Units</value><footnoteId id="F1"/><footnoteId id="F1"/></securityTitle><transactionDate><value>2022-11-15</value></transactionDate>
<transactionCoding><transactionFormType>5</transactionFormType><transactionCode>G</transactionCode><footnoteId id="F2"/></transactionCoding><transactionTimeliness><value>E</value></transactionTimeliness>
<transactionAmounts><transactionShares><value>2,340.25</value></transactionShares><transactionAcquiredDisposedCode><value>D</value></transactionAcquiredDisposedCode></transactionAmounts>
<ownershipNature><directOrIndirectOwnership><value>I</value></directOrIndirectOwnership><natureOfOwnership><value>By trust</value></natureOfOwnership></ownershipNature></nonDerivativeTransaction></nonDerivativeTable>
<derivativeTable><derivativeTransaction><securityTitle>Option</securityTitle><conversionOrExercisePrice><value>3.5</value></conversionOrExercisePrice><transactionAmounts><transactionTotalValue><value>70</value></transactionTotalValue></transactionAmounts></derivativeTransaction></derivativeTable>
<footnotes><footnote id="F1">By <b>will</b>.</footnote><footnote id="F2">Gift.</footnote></footnotes>
<ownerSignature><signatureName>/s/ K Ash</signatureName><signatureDate>2022-12-02</signatureDate></ownerSignature><ownerSignature><signatureName>Nobody</signatureName></ownerSignature></ownershipDocument>"""

COVER = """<XML><s:submission xmlns:s="urn:cover"><s:headerData><s:submissionType>13F-HR/A</s:submissionType><s:filerInfo><s:filer><s:credentials><s:cik>0000004242</s:cik></s:credentials></s:filer></s:filerInfo></s:headerData>
<s:formData><s:coverPage><s:filingManager><s:name>Harbour Street Partners</s:name></s:filingManager></s:coverPage><s:periodOfReport>2022-09-30</s:periodOfReport></s:formData></s:submission></XML>"""
REPORT = COVER + """<xml><t:informationTable xmlns:t="urn:rows">
<t:infoTable><t:nameOfIssuer>ALDER MILLS</t:nameOfIssuer><t:titleOfClass>CL A</t:titleOfClass><t:cusip>11111AA10</t:cusip><t:value>812</t:value><t:shrsOrPrnAmt><t:sshPrnAmt>90</t:sshPrnAmt><t:sshPrnAmtType>SH</t:sshPrnAmtType></t:shrsOrPrnAmt><t:investmentDiscretion>SOLE</t:investmentDiscretion></t:infoTable>
<t:infoTable><t:nameOfIssuer>CEDAR RAIL</t:nameOfIssuer><t:titleOfClass>NOTE 4%</t:titleOfClass><t:cusip>22222BB20</t:cusip><t:value>15</t:value><t:shrsOrPrnAmt><t:sshPrnAmt>15000</t:sshPrnAmt><t:sshPrnAmtType>PRN</t:sshPrnAmtType></t:shrsOrPrnAmt></t:infoTable></t:informationTable></xml>"""


def test_envelope(spark):
    df = spark.createDataFrame([("k", ENVELOPE.encode("latin1")), ("empty", None)], "key string, content binary")
    rows = {r.key: r for r in envelope.filings(df, "key", "content").collect()}
    r = rows["k"]
    assert (r.accession_number, r.form_type, r.document_count, r.company_name) == ("0000009876-22-000005", "8-K", 2, "Larch Savings Co")
    assert (r.cik, r.state_incorporation, r.sic, str(r.date_filed)) == ("0000005150", "ME", "PAPER MILLS [2621]", "2024-02-01")
    assert [(d.type, d.sequence, d.content_type) for d in r.documents] == [("8-K", "1", "text/html"), ("EX-99", "2", "text/plain")]
    for d in r.documents:
        assert ENVELOPE[d.start_pos : d.end_pos].startswith("<DOCUMENT>") and ENVELOPE[: d.end_pos].endswith("</DOCUMENT>")
    assert rows["empty"].documents == []
    h = df.where("key = 'k'").select(envelope.header_field(envelope.header_only("content"), "COMPANY CONFORMED NAME").alias("n")).first()
    assert h.n == "Larch Savings Co"


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(max_size=400), st.text(alphabet="<>/DOCUMENT:TYPE \n\x00é", max_size=300)))
def test_any_input_gives_records(raw):
    assert isinstance(envelope.parse(raw)["documents"], list)
    assert isinstance(ownership.ground_truth(raw), dict)
    assert "holdings" in holdings.report(raw)
    html.read(raw if isinstance(raw, str) else raw.decode("latin1"))


def test_ownership_tables(spark, tmp_path):
    df = spark.createDataFrame([("acc", FORM), ("bad", "<ownershipDocument>")], "accession string, content string")
    made = ownership.tables(df, "accession", "content", str(tmp_path / "parsed"))
    t = {k: v.collect() for k, v in made.items()}
    s = t["ownership_submission"][0]
    assert len(t["ownership_submission"]) == 1 and (s.issuer_cik, s.issuer_name, str(s.period_of_report)) == ("0000000077", "Willow & Reed", "2022-11-30")
    x = t["ownership_nonderiv_transaction"][0]
    assert (x.sequence_key, x.rptowner_cik, x.transaction_shares, x.transaction_code, x.transaction_timeliness) == (2, 905, 2340.25, "G", "E")
    assert (x.security_title_fn, x.transaction_code_fn) == ("1", "2") and x.transaction_price_per_share is None
    assert t["ownership_nonderiv_holding"][0].sequence_key == 1 and t["ownership_deriv_holding"] == []
    assert [(o.rptowner_cik, o.is_officer, o.is_10pctowner) for o in t["ownership_reporting_owner"]] == [(905, True, False), (906, False, True)]
    assert len(t["ownership_signature"]) == 1 and {r.footnote_text for r in t["ownership_footnote"]} == {"By will.", "Gift."}
    assert [(r.accession, r.is_error) for r in t["ownership_error"]] == [("bad", True)]
    assert {k: sorted(map(str, v.collect())) for k, v in ownership.tables(df, "accession", "content").items()} == {k: sorted(map(str, v)) for k, v in t.items()}
    record = json.loads(ownership.nested_records(made, "accession").first().record)
    assert [o["rptowner_cik"] for o in record["reporting_owners"]] == ["0000000905", "0000000906"]
    move = record["non_derivative_transactions"][0]
    assert (move["shares"], move["price"], move["security_title_fn"], move["transaction_summary"]) == (2340.25, 0.0, ["1"], "Units was disposed (Code G). [Note 1: By will.] [Note 2: Gift.]")
    assert record["derivative_holdings"] == [] and record["derivative_transactions"][0]["conversion_or_exercise_price"] == 3.5


def test_ownership_markdown():
    md = ownership.markdown_of(FORM)
    assert md == ownership.markdown_of(FORM.encode())
    assert "| Security | Date | Deemed Exec | Code | Form Type | A/D | Equity Swap | Timeliness | Shares | Price | Total Value | Owned After | Value After | Nature |" in md
    line = next(x for x in md.splitlines() if x.startswith("| Units"))
    assert re.search(r"\|\s*5\s*\|\s*D\s*\|", line) and line.endswith("| I (By trust) |") and "[^1]" in line
    assert "| Option | 3.5 |  |  |  | 70 |" in md and "### Ash K (0000000905)" in md
    assert ownership.ground_truth(FORM)["nonderiv_transactions"][0]["transaction_price_per_share"] == 0.0
    assert ownership.rationale("A", "M", "Stock", ["1", "1", "9"], {"1": "x"}) == "Stock was acquired (Code M). [Note 1: x]"


def test_holdings(spark):
    r = holdings.report(REPORT)
    assert (r["form_type"], r["manager_name"], r["manager_cik"], len(r["holdings"])) == ("13F-HR/A", "Harbour Street Partners", "0000004242", 2)
    assert [(h["cusip"], h["sh_type"], h["discretion"], h["ticker"]) for h in r["holdings"]] == [("11111AA10", "SH", "SOLE", None), ("22222BB20", "PRN", "", None)]
    assert holdings.report("<XML><a></XML>")["error"] and holdings.report(COVER)["holdings"] == []
    assert holdings.to_markdown(COVER).endswith(holdings.NOTHING) and "| CEDAR RAIL | NOTE 4% | 22222BB20 | 15 | 15000 | PRN |  |" in holdings.to_markdown(REPORT)
    row = spark.createDataFrame([(REPORT,)], "c string").select(holdings.holdings_report("c").alias("r")).first().r
    assert row.form_type == "13F-HR/A" and row.holdings[1].shares == "15000"
    assert registry.parser_for(" 4/a ") is registry.parser_for("3") and registry.parser_for("10-K") is None


def test_html():
    page = "<html><head><title>T</title></head><body><script>x</script><h2>Head</h2><p>one <b>two</b></p><style>y</style></body></html>"
    assert html.read(page) == "Head one two"
    assert html.read(page, True).startswith("## Head\n")


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab#\n ", max_size=300), st.integers(5, 60))
def test_chunks_cover_the_text(text, limit):
    ends = chunking.cut_points(text, limit, r"^#{1,2}\s")
    assert (ends[-1] if ends else 0) == len(text)
    assert all(0 < b - a <= limit for a, b in zip([0, *ends], ends, strict=False))


def test_sections(spark):
    md = "intro\n# A\nx\n### C\ny\n## B\n\n# D\nz"
    rows = spark.createDataFrame([(md,)], "md string").select(chunking.markdown_sections("md").alias("s")).first().s
    assert [(r.section, r.content) for r in rows] == [("prologue", "intro"), ("A", "x"), ("A > unknown > C", "y"), ("D", "z")]


def test_a_form_is_read_once_whatever_is_filtered(spark):
    """Filters on what a reader gave used to bring a second reading of each form."""
    df = spark.createDataFrame([("a", FORM), ("b", "<ownershipDocument><broken"), ("c", None)], "accession string, content string")
    every = {**ownership.tables(df, "accession", "content"), "errors": ownership.errors(df, "accession", "content"), "truths": ownership.ground_truths(df, "accession", "content")}
    for name, rows in every.items():
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") + plan.count("EvalPython") == 1, name
    assert sorted(r.accession for r in every["errors"].collect()) == ["b", "c"]
    assert [r.accession for r in every["truths"].collect()] == ["a"]


def test_parts_of_a_record_are_those_of_the_whole():
    whole = ownership.record(FORM)
    for part in ownership.PARTS:
        assert ownership.record(FORM, (part,)) == {k: v for k, v in whole.items() if (k in ownership.HEAD if part == "head" else k == part)}


def test_references_without_their_semicolon_are_text():
    page = "<p>and&amp</p><p>a &am b &amp; &#65; &copy; &unknown; R&D</p>"
    assert html.read(page) == "and&amp a &am b & A © &unknown; R&D"
    assert html.read(page, True) == "and&amp\n\na &am b & A © &unknown; R&D"


def test_rows_of_table_functions_are_no_arrow_batches(spark):
    from quarry.parsers import table_functions

    table_functions.register_all(spark)
    df = spark.createDataFrame([("a", FORM)], "k string, content string")
    rows = spark.sql("SELECT k, r.kind FROM {df}, LATERAL ownership_rows(content) r", df=df)
    assert "ArrowEvalPythonUDTF" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() > 1


def test_envelopes_are_dealt(spark):
    """one file's filings are dealt to all tasks before they are parsed; a null key stays null."""
    from quarry.plans import forms

    plan = forms.par_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "MapInArrow" in plan
    df = spark.createDataFrame([(None, b"<DOCUMENT>\n<TYPE>X\n<TEXT>\nbody</TEXT>\n</DOCUMENT>"), (2, None)], "k long, c binary")
    got = {r.k: [bytes(d.content) for d in r.documents] for r in envelope.filings(df, "k", "c").collect()}
    assert got == {None: [b"\nbody"], 2: []}


def test_forms_alike_are_read_in_full_once(monkeypatch):
    """every form used to go through the XML reader, whatever its like."""
    alike = FORM.replace("By <b>will</b>.", "By will.")
    other = alike.replace("Willow & Reed", "Elm &amp; Co > Sons").replace("2,340.25", " 7 ").replace("By will.", "").replace('id="F2"', 'id="F1"')
    row = alike[alike.index("<nonDerivativeTransaction>") : alike.index("</nonDerivativeTable>")]
    longer = alike.replace("</nonDerivativeTable>", row.replace("Units", "More") + "</nonDerivativeTable>")
    odd = [alike.replace(a, b) for a, b in (
        ("Units", "<!-- x -->Units"), ("Units", "<![CDATA[U & V]]>"), ("Units", "U]]>"), ("Units", "U\x01nits"), ("Units", "Un&#65;its"), ("Units", "Unités"),
        ("</nonDerivativeTable>", "</nonDerivativeTable>" + "<nonDerivativeTable>" + row + "</nonDerivativeTable>"), ("</nonDerivativeTable>", "<x/>" + row + "</nonDerivativeTable>"),
        ("<nonDerivativeTransaction>", "<nonDerivativeTransaction>text"), ("</issuer>", row + "</issuer>"), ('<footnoteId id="F2"/>', '<footnoteId id="F"/>'),
        ("<transactionTimeliness><value>E</value>", "<transactionTimeliness><value></value>"), ("</ownershipDocument>", "</x></ownershipDocument>"),
    )]
    forms = [alike, other, longer, *odd, FORM]
    assert [json.dumps(ownership.record(f)) for f in forms] == [json.dumps(ownership._whole(f, ownership.PARTS)) for f in forms]
    read = []
    monkeypatch.setattr(ownership, "root_of", lambda text: read.append(text))
    assert ownership.record(other)["issuer_name"] == "Elm & Co > Sons" and len(ownership.record(longer)["nonderiv_transactions"]) == 2 and read == []


def test_rows_of_many_forms_are_whole_columns(spark):
    """the query used to take and pickle a row at a time."""
    from quarry.plans import indexes

    plan = indexes.udf_lateral_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EvalPythonUDTF" not in plan and plan.count("ArrowEvalPython") == 1
    df = spark.createDataFrame([("a", FORM), ("b", "<ownershipDocument><broken"), ("c", None)], "k string, content string")
    one = spark.sql("SELECT k, r.kind, r.position, map_entries(r.fields) AS f FROM {df}, LATERAL ownership_rows(content) r", df=df)
    many = spark.sql("SELECT k, r.kind, r.position, map_entries(r.fields) AS f FROM {df} LATERAL VIEW inline(ownership_list(content)) r AS kind, position, fields", df=df)
    said = [sorted((r.k, r.kind, r.position, sorted(map(tuple, r.f))) for r in rows.collect()) for rows in (one, many)]
    assert said[0] == said[1] and len(said[0]) == 12


def test_ground_truths_of_parts(spark):
    """a query of two parts used to take the whole record as JSON."""
    from quarry.plans import forms

    df = spark.createDataFrame([("a", FORM), ("b", "<ownershipDocument><broken"), ("c", FORM.replace("2,340.25", "many"))], "k string, content string")
    whole = {r.k: json.loads(r.r) for r in ownership.ground_truths(df, "k", "content").collect()}
    some = {r.k: json.loads(r.r) for r in ownership.ground_truths(df, "k", "content", ("head", "nonderiv_transactions")).collect()}
    assert some == {k: {c: v for c, v in r.items() if c in ownership.HEAD or c == "nonderiv_transactions"} for k, r in whole.items()} and set(some) == {"a", "c"}
    assert some["c"]["nonderiv_transactions"][0]["transaction_shares"] == 0.0
    assert forms.par_ground_truth(spark, "/root/testdata/sf0.001").count() > 0


def test_markdown_of_forms_alike_needs_one_full_reading(monkeypatch):
    """each form used to be read in full for its Markdown."""
    alike = FORM.replace("By <b>will</b>.", "By will.")
    want = [ownership.markdown_of(alike), ownership.markdown_of(alike.replace("Units", "Warrants"))]
    monkeypatch.setattr(ownership, "root_of", lambda text: None)
    assert [ownership.markdown_of(alike), ownership.markdown_of(alike.replace("Units", "Warrants"))] == want
    assert "| Warrants [^1] | 2022-11-15 |" in want[1] and "| I (By trust) |" in want[1]


def test_nested_records_need_no_shuffle_of_rows(spark):
    """each list of the record used to be grouped and joined by itself."""
    from quarry.plans import forms

    other = FORM.replace("<value>E</value>", "").replace("2,340.25", "many").replace('id="F2"', 'id="F1,F9"').replace("0000000905", "999").replace("<signatureName>Nobody</signatureName>", "<signatureName>A</signatureName><signatureDate>20221201</signatureDate>")
    bare = "<ownershipDocument><issuer><issuerCik>-7</issuerCik></issuer></ownershipDocument>"
    df = spark.createDataFrame([("a", FORM), ("b", "<ownershipDocument><broken"), ("c", other), ("d", bare)], "k string, content string")
    want = {r.k: json.loads(r.record) for r in ownership.nested_records(ownership.tables(df, "k", "content"), "k").collect()}
    rows = ownership.nested(df, "k", "content")
    assert {r.k: json.loads(r.record) for r in rows.collect()} == want and set(want) == {"a", "c", "d"}
    some = {r.k: json.loads(r.record) for r in ownership.nested(df, "k", "content", ("head", "nonderiv_transactions")).collect()}
    left = ("reporting_owners", "non_derivative_holdings", "derivative_transactions", "derivative_holdings", "signatures", "footnotes")
    assert some == {k: {c: v for c, v in r.items() if c not in left} for k, r in want.items()}
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    plan = forms.par_nested_record(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "json" not in plan and plan.count("MapInArrow") == 1 and plan.count("Generate explode") == 1
