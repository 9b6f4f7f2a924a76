"""Tagged filing envelopes: a header of fields and sections, then documents."""

from __future__ import annotations

import hashlib
import mimetypes
import re
from collections.abc import Iterator
from datetime import date, datetime
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.codecs import uudecode_text
from ..functions.udf import BYTES, ROWS

#: Sections that name a filing's company, best first.
ENTITIES = ["subject-company", "filed-by", "filer", "issuer", "reporting-owner"]
ACCESSION = re.compile(T.ACCESSION)
TAGGED, NAMED = re.compile(r"^(\s*)<([A-Za-z0-9-]+)>(.*)$"), re.compile(r"^(\s*)([^:<>]+?)\s*:(.*)$")
OPEN, CLOSE = "<DOCUMENT>", "</DOCUMENT>"

DOCUMENT = (
    "struct<type: string, sequence: string, file_name: string, description: string, content_type: string,"
    " sha1: string, content: binary, start_pos: bigint, end_pos: bigint>"
)
FILING = (
    "accession_number string, form_type string, document_count int, reporting_period date, date_filed date,"
    " company_name string, cik string, sic string, irs_number string, state_incorporation string,"
    f" full_metadata string, documents array<{DOCUMENT}>"
)

_T, _DAY = pa.string(), pa.date32()
_DOCUMENT = pa.struct([*((n, _T) for n in ("type", "sequence", "file_name", "description", "content_type", "sha1")), ("content", pa.binary()), ("start_pos", pa.int64()), ("end_pos", pa.int64())])
#: Arrow's types of FILING's columns.
_FILING = [_T, _T, pa.int32(), _DAY, _DAY, *[_T] * 6, pa.list_(_DOCUMENT)]


def decode(raw: bytes | str | None) -> str:
    """UTF-8 or, failing that, ISO 8859-1."""
    if raw is None or isinstance(raw, str):
        return raw or ""
    try:
        return bytes(raw).decode("utf-8")
    except UnicodeDecodeError:
        return bytes(raw).decode("iso-8859-1")


def header_of(text: str) -> str:
    """What stands between header tags, or before the first document."""
    for tag in ("SEC-HEADER", "IMS-HEADER"):
        a, b = text.find(f"<{tag}>"), text.find(f"</{tag}>")
        if 0 <= a < b:
            return text[a + len(tag) + 2 : b]
    return text.partition(OPEN)[0]


@lru_cache(4096)
def _key(raw: str) -> str:
    key = "".join(c for c in raw if " " <= c <= "~").strip().lower()
    return re.sub(r"[\s_]+", "-", key)


def header_tree(header: str) -> dict:
    """Fields by section.  A name without a value opens a section; deeper
    lines belong to it.  A section that comes again becomes a list."""
    root: dict = {}
    open_at: list[tuple[int, dict]] = [(-1, root)]
    for line in header.replace("\0", "").splitlines():
        m = TAGGED.match(line) or NAMED.match(line)
        if not m:
            continue
        depth, key, value = len(m[1].expandtabs(4)), _key(m[2]), m[3].strip() if "</" not in m[3] else re.sub(r"</.*?>", "", m[3]).strip()
        if ACCESSION.match(value):
            key = "accession-number"
        if not key:
            continue
        while open_at[-1][0] >= depth:
            open_at.pop()
        home = open_at[-1][1]
        if value:
            home.setdefault(key, value)
            continue
        section: dict = {}
        if key not in home:
            home[key] = section
        elif isinstance(home[key], list):
            home[key].append(section)
        elif isinstance(home[key], dict):
            home[key] = [home[key], section]
        open_at.append((depth, section))
    return root


def _first(tree: dict, *keys: str) -> str | None:
    return next((tree[k] for k in keys if isinstance(tree.get(k), str) and tree[k]), None)


@lru_cache(4096)
def _date(value: str | None) -> date | None:
    for layout in ("%Y%m%d", "%Y-%m-%d", "%m/%d/%Y", "%Y%m%d%H%M%S", "%B %d, %Y"):
        try:
            return datetime.strptime(value or "", layout).date()
        except ValueError:
            continue
    return None


def _entity(tree: dict) -> dict:
    """The first section with a company's name, else the last with any data."""
    best: dict = {}
    for name in ENTITIES:
        found = tree.get(name)
        for section in found if isinstance(found, list) else [found]:
            data = section and (section.get("company-data") or section.get("owner-data"))
            if isinstance(data, dict) and data:
                best = data
                if _first(data, "company-conformed-name", "conformed-name", "name"):
                    return data
    return best


def sniff(head: str, file_name: str | None) -> tuple[str, bool]:
    """Content type from a body's first characters; whether it is uuencoded."""
    upper = head.upper()
    if "<PDF>" in upper:
        return "application/pdf", True
    if "<HTML" in upper:
        return "text/html", False
    if "<XML" in upper or "<?XML" in upper:
        return "application/xml", False
    if head.startswith("\nbegin "):
        return mimetypes.guess_type(file_name or "")[0] or "application/octet-stream", True
    return "text/plain", False


def document_of(raw: str, form_type: str | None) -> dict:
    """One document's tags and body; the body fills the innermost element
    that closes last before the document does."""

    def tag(name: str) -> str | None:
        m = re.search(rf"(?i)<{name}>\s*([^\r\n]*)", raw)
        return m[1].strip() if m else None

    closing = re.findall(r"</([^>]*)>", raw)
    inner = closing[-2] if len(closing) > 1 else closing[-1] if closing else ""
    a, b = raw.find(f"<{inner}>"), raw.find(f"</{inner}>")
    body = raw[a + len(inner) + 2 : b] if 0 <= a < b else ""
    name = tag("FILENAME")
    kind, coded = sniff(body[:100], name)
    content = (uudecode_text(body) if coded else body.encode("utf-8", "ignore")) or b""
    return {
        "type": tag("TYPE") or form_type, "sequence": tag("SEQUENCE"), "file_name": name, "description": tag("DESCRIPTION"),
        "content_type": kind, "sha1": hashlib.sha1(content).hexdigest(), "content": content,
    }


def document_spans(text: str) -> Iterator[tuple[int, int]]:
    at = text.find(OPEN)
    while at >= 0:
        end = text.find(CLOSE, at)
        stop = end + len(CLOSE) if end >= 0 else len(text)
        yield at, stop
        at = text.find(OPEN, stop)


def parse(raw: bytes | str | None) -> dict:
    """A whole envelope.  Any input gives a record; nothing is raised."""
    import json

    text = decode(raw)
    tree = header_tree(header_of(text))
    form = _first(tree, "type", "conformed-submission-type")
    count = _first(tree, "public-document-count")
    who = _entity(tree)
    cik = _first(who, "central-index-key", "cik")
    documents = []
    for a, b in document_spans(text):
        documents.append({**document_of(text[a:b], form), "start_pos": a, "end_pos": b})
    return {
        "accession_number": _first(tree, "accession-number"),
        "form_type": form,
        "document_count": int(count) if count and re.fullmatch(r"\d{1,9}", count) else None,
        "reporting_period": _date(_first(tree, "conformed-period-of-report", "period")),
        "date_filed": _date(_first(tree, "filing-date", "filed-as-of-date", "date-filed")),
        "company_name": _first(who, "company-conformed-name", "conformed-name", "name"),
        "cik": cik.zfill(10) if cik else None,
        "sic": _first(who, "standard-industrial-classification", "assigned-sic", "sic"),
        "irs_number": _first(who, "irs-number", "irs"),
        "state_incorporation": _first(who, "state-of-incorporation", "state"),
        "full_metadata": json.dumps(tree, sort_keys=True),
        "documents": documents,
    }


def filings(df: DataFrame, key: str, content: str) -> DataFrame:
    """``key`` and the parsed envelope of each row's content."""
    kind = df.schema[key].dataType.simpleString()
    names = list(parse(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(ROWS, batch.num_rows * BYTES // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows = [parse(c) for c in part.column(1).to_pylist()]
                cols = [pa.array([r[n] for r in rows], k) for n, k in zip(names, _FILING, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], [key, *names])

    return df.select(key, content).mapInArrow(run, f"{key} {kind}, {FILING}")


def header_field(header: Column | str, field: str) -> Column:
    """A header's field by name: tagged, at a line's start, or anywhere."""
    name = re.escape(field).replace(r"\ ", "[ -]")
    patterns = [rf"(?im)<{name}>\s*([^\r\n]*)$", rf"(?im)^\s*(?:{name})\s*[:>]?\s*([^\r\n]*)$", rf"(?im)(?:{name})\s*[:>]?\s*([^\r\n]*)$"]
    found = [T.strip(F.regexp_replace(F.regexp_replace(F.regexp_extract(T.col(header), p, 1), "</.*?>", ""), "^>+", "")) for p in patterns]
    return F.coalesce(*(F.nullif(f, F.lit("")) for f in found))


def header_only(content: Column | str, limit: int = 32769) -> Column:
    """The first bytes of a file, where its header is."""
    return T.decoded(F.substring(T.col(content), 1, limit))
