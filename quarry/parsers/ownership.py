"""Ownership forms (3, 4, 5): XML to nested records, tables and Markdown.

What a row holds is a table of (column, path, kind); one reader fills any of
them, and every valued element also gives its footnote references.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import dates as D
from ..functions import numbers as N
from ..functions import text as T
from ..functions import values as V
from ..functions.udf import arrow_udf
from ..operators.nested import error_rows

OWNER = {
    "rptowner_cik": "reportingOwnerId/rptOwnerCik", "rptowner_ccc": "reportingOwnerId/rptOwnerCcc", "rptowner_name": "reportingOwnerId/rptOwnerName",
    "is_director": "reportingOwnerRelationship/isDirector", "is_officer": "reportingOwnerRelationship/isOfficer",
    "is_10pctowner": "reportingOwnerRelationship/isTenPercentOwner", "is_other": "reportingOwnerRelationship/isOther",
    "officer_title": "reportingOwnerRelationship/officerTitle", "other_text": "reportingOwnerRelationship/otherText",
    "is_director_nominee": "reportingOwnerRelationship/isDirectorNominee",
    "street1": "reportingOwnerAddress/rptOwnerStreet1", "street2": "reportingOwnerAddress/rptOwnerStreet2",
    "city": "reportingOwnerAddress/rptOwnerCity", "state": "reportingOwnerAddress/rptOwnerState", "zip": "reportingOwnerAddress/rptOwnerZipCode",
    "state_description": "reportingOwnerAddress/rptOwnerStateDescription", "country": "reportingOwnerAddress/rptOwnerCountry",
    "non_us_address_flag": "reportingOwnerAddress/rptOwnerNonUSAddressFlag",
    "non_us_state_territory": "reportingOwnerAddress/rptOwnerNonUSStateTerritory", "good_address": "reportingOwnerAddress/rptOwnerGoodAddress",
}
HEAD = {
    "issuer_cik": "issuer/issuerCik", "issuer_name": "issuer/issuerName", "issuer_trading_symbol": "issuer/issuerTradingSymbol",
    "issuer_foreign_trading_symbol": "issuer/issuerForeignTradingSymbol", "form_type": "documentType", "schema_version": "schemaVersion",
    "period_of_report": "periodOfReport", "remarks": "remarks", "date_of_original_submission": "dateOfOriginalSubmission",
    "not_subject_to_section_16": "notSubjectToSection16", "is_rule_10b5_1_plan": "aff10b5One", "no_securities_owned": "noSecuritiesOwned",
}
_POST = {
    "shares_owned_following_transaction": "postTransactionAmounts/sharesOwnedFollowingTransaction",
    "value_owned_following_transaction": "postTransactionAmounts/valueOwnedFollowingTransaction",
    "direct_or_indirect_ownership": "ownershipNature/directOrIndirectOwnership", "nature_of_ownership": "ownershipNature/natureOfOwnership",
    "transaction_form_type": "transactionCoding/transactionFormType",
}
_MOVE = {
    "transaction_date": "transactionDate", "deemed_execution_date": "deemedExecutionDate", "transaction_code": "transactionCoding/transactionCode",
    "equity_swap_involved": "transactionCoding/equitySwapInvolved", "transaction_timeliness": "transactionTimeliness",
    "transaction_acquired_disposed_code": "transactionAmounts/transactionAcquiredDisposedCode",
    "transaction_shares": "transactionAmounts/transactionShares", "transaction_price_per_share": "transactionAmounts/transactionPricePerShare",
    "transaction_total_value": "transactionAmounts/transactionTotalValue",
}
_UNDER = {
    "conversion_or_exercise_price": "conversionOrExercisePrice", "exercise_date": "exerciseDate", "expiration_date": "expirationDate",
    "underlying_security_title": "underlyingSecurity/underlyingSecurityTitle", "underlying_security_shares": "underlyingSecurity/underlyingSecurityShares",
    "underlying_security_value": "underlyingSecurity/underlyingSecurityValue",
}
_TITLE = {"security_title": "securityTitle"}
SIGNATURE = {"signature_name": "signatureName", "signature_date": "signatureDate"}
#: Row kinds: list name, table element, row element, columns.
ROWS = {
    "nonderiv_transactions": ("nonDerivativeTable", "nonDerivativeTransaction", _TITLE | _MOVE | _POST),
    "nonderiv_holdings": ("nonDerivativeTable", "nonDerivativeHolding", _TITLE | _POST),
    "deriv_transactions": ("derivativeTable", "derivativeTransaction", _TITLE | _UNDER | _MOVE | _POST),
    "deriv_holdings": ("derivativeTable", "derivativeHolding", _TITLE | _UNDER | _POST),
}
#: A reference hangs on the coding element, or the timeliness stands there.
_ELSEWHERE = {"transaction_code": "transactionCoding", "transaction_timeliness": "transactionCoding/transactionTimeliness"}
NUMBERS = {c for c in [*_POST, *_MOVE, *_UNDER] if re.search("shares|price|value", c)}
DATES = {"transaction_date", "deemed_execution_date", "exercise_date", "expiration_date", "period_of_report", "date_of_original_submission"}
FLAGS = {"equity_swap_involved", "non_us_address_flag", "good_address", "not_subject_to_section_16", "is_rule_10b5_1_plan", "no_securities_owned"}
FLAGS |= {c for c in OWNER if c.startswith("is_")}


def isolate(text: str) -> str:
    if text.isascii():
        low = text.lower()
        start = low.find("<ownershipdocument")
        end = low.find("</ownershipdocument>", start + 18) if start >= 0 else -1
        if end >= 0:
            return text[start : end + 20]
    m = re.search(r"(?is)<ownershipDocument.*?</ownershipDocument>", text) or re.search(r"(?is)<\?xml.*", text)
    return (m[0] if m else text).strip()


def root_of(text: str) -> ET.Element | None:
    """The document element without namespaces; stray ampersands and control
    characters are forgiven."""
    xml = isolate(text)
    for repair in (False, True):
        if repair:
            xml = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", xml)
            xml = re.sub(r"&(?!#?\w{1,8};)", "&amp;", xml)
        try:
            root = ET.fromstring(xml.encode("utf-8", "ignore"))
        except (ET.ParseError, ValueError):
            continue
        plain: dict[str, str] = {}
        for e in root.iter():
            tag = e.tag
            if tag in plain:
                e.tag = plain[tag]
            elif isinstance(tag, str):
                e.tag = plain[tag] = tag.rpartition("}")[2]
        return root
    return None


def _found(home: ET.Element) -> dict[str, ET.Element]:
    """The first element of each path of one or two steps, in one walk."""
    found: dict[str, ET.Element] = {}
    for a in home:
        tag = a.tag
        if tag not in found:
            found[tag] = a
        for b in a:
            path = f"{tag}/{b.tag}"
            if path not in found:
                found[path] = b
    return found


def _text(e: ET.Element | None) -> str:
    if e is None:
        return ""
    inner = (e.findtext("value") or "").strip()
    return inner or (e.text or "").strip()


def _refs(e: ET.Element | None) -> list[str]:
    ids = [(x.get("id") or "").upper().replace("F", "").strip() for x in (e.iter("footnoteId") if e is not None else ())]
    return [i for i in dict.fromkeys(ids) if i]


def _texts(home: ET.Element, paths: dict[str, str]) -> dict[str, str]:
    found = _found(home)
    return {c: _text(found.get(p)) for c, p in paths.items()}


#: By kind of rows: the columns that a path fills, and a row without any.
_COLUMN = {name: {p: c for c, p in cols.items()} for name, (_, _, cols) in ROWS.items()}
_EMPTY = {name: {"sequence_key": 0} | dict.fromkeys(cols, "") | {f"{c}_fn": [] for c in cols} for name, (_, _, cols) in ROWS.items()}


def _row(name: str, i: int, home: ET.Element) -> dict:
    found, column, out = _found(home), _COLUMN[name], dict(_EMPTY[name])
    out["sequence_key"] = i
    for path, e in found.items():
        c = column.get(path)
        if c is not None:
            out[c] = _text(e)
            if len(e) and (refs := _refs(e)):
                out[f"{c}_fn"] = refs
    for c, path in _ELSEWHERE.items():
        if c in out:
            if c == "transaction_timeliness":
                out[c] = out[c] or _text(found.get(path))
            out[f"{c}_fn"] = out[f"{c}_fn"] or _refs(found.get(path))
    return out


#: What a record is made of.
PARTS = ("head", "owners", *ROWS, "footnotes", "signatures")

# Forms are written alike: the tags between two rows, and those of a row, are the same
# in many.  Such a stretch is a shape, an expression with a group for each text and id;
# where a form's shapes put their groups in its record is found once, by the full reader,
# from a form that has marks for texts.

_TAG = re.compile(r"(<[^<>]*>)([^<]*)")
_PLAIN_TAG = re.compile(r'</?[A-Za-z][A-Za-z0-9]*/?>|<ownershipDocument xmlns="(?!http://www\.w3\.org/)[^"<&\s]+">')
_ID_TAG = re.compile(r'<footnote(?:(Id) id="[Ff]?[0-9]+"/|\ id="[^"<&\s]*")>')
_ROW_TAG = re.compile(f"<({'|'.join(row for _, row, _ in ROWS.values())})>")
_LIST = {row: name for name, (_, row, _) in ROWS.items()}
_MARK = re.compile(r"\{(\d+)\}")
_ENTITY = re.compile(r"&#?\w{1,8};")
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
#: What XML forbids or changes.
_ODD = bytes(i for i in range(128) if i not in (9, 10) and not 32 <= i < 127)
#: Shapes of a kind, and ways to join them, that a process learns; other forms are read in full.
_SHAPES_MOST, _PLANS_MOST = 24, 500
#: By row element (none: between rows): number, expression, marked text, a row's texts and references.
_SHAPES: dict[str, list[tuple]] = {tag: [] for tag in ("", *_LIST)}
_PLANS: dict[tuple, tuple | None] = {}


def _unescaped(text: str) -> str:
    for entity, sign in _ENTITIES.items():
        text = text.replace(entity, sign)
    return text.strip()


@lru_cache(4096)
def _ids(raw: tuple[str, ...]) -> list[str]:
    return list(dict.fromkeys(x.upper().replace("F", "") for x in raw))


def _marked(pieces: list[str], at: int = 0) -> str:
    return "".join(f"{{{at + i}}}{piece}" if i >= 0 else piece for i, piece in enumerate(pieces, -1))


def _slots(values: dict[str, str]) -> list[tuple[str, int]]:
    """Columns and the groups they come from; a text that is no single mark is an error."""
    return [(c, int(_MARK.fullmatch(v)[1])) for c, v in values.items() if v != ""]  # type: ignore[index]


def _shape(xml: str, tag: str) -> tuple | None:
    """The shape of a stretch of a form, if it is plain enough to have one."""
    tags = _TAG.findall(xml)
    if sum(len(t) + len(text) for t, text in tags) != len(xml) or xml.count("<transactionTimeliness") > 1 and tag:
        return None
    pattern, pieces = "", [""]
    for i, (t, text) in enumerate(tags):
        if found := _ID_TAG.fullmatch(t):
            before, _, after = t.split('"')
            pattern += re.escape(before) + ('"([Ff]?[0-9]+)"' if found[1] else '"([^"<&\\s]*)"') + re.escape(after)
            pieces[-1] += before + '"'
            pieces.append('"' + after)
        elif _PLAIN_TAG.fullmatch(t):
            pattern += re.escape(t)
            pieces[-1] += t
        else:
            return None
        name = t[1:-1].partition(" ")[0]
        if i + 1 < len(tags) and tags[i + 1][0] == f"</{name}>":
            pattern += "([^<]*)"
            pieces.append("")
        elif text.strip():
            return None
        elif text:
            pattern += r"\s*"
    texts, refs = [], []
    if tag:
        try:
            row = _row(_LIST[tag], 0, ET.fromstring(_marked(pieces)))
            texts = _slots({c: v for c, v in row.items() if isinstance(v, str)})
            refs = [(c, [int(_MARK.fullmatch(x)[1]) for x in v]) for c, v in row.items() if isinstance(v, list) and v]  # type: ignore[index]
        except (ET.ParseError, TypeError):
            return None
    return len(_SHAPES[tag]), re.compile(pattern), pieces, texts, refs


def _plan(shapes: list[tuple | list[str]]) -> tuple | None:
    """Where shapes one after another, a run of rows as its row elements, have a
    record's texts; None if their forms are to be read in full."""
    xml, at, runs = "", 0, []
    for shape in shapes:
        if isinstance(shape, list):
            runs.append(shape)
            xml += "".join(f"<{tag}></{tag}>" for tag in shape)
        else:
            xml += _marked(shape[2], at)
            at += len(shape[2]) - 1
    r = _whole(xml, PARTS)
    # Rows stand where they count, those of a table next to each other.
    tags = [tag for run in runs for tag in run]
    if r is None or isolate(xml) != xml or len(set(tags)) != len(tags) or any(len(r[_LIST[tag]]) != 1 for tag in tags):
        return None
    if len({ROWS[_LIST[run[0]]][0] for run in runs}) != len(runs) or any(r[name] for name, (_, row, _) in ROWS.items() if row not in tags):
        return None
    try:
        notes = [(int(_MARK.fullmatch(i)[1]), int(_MARK.fullmatch(t)[1]) if t else -1) for i, t in r["footnotes"].items()]  # type: ignore[index]
        return _slots({c: r[c] for c in HEAD}), [_slots(o) for o in r["owners"]], notes, [_slots(s) for s in r["signatures"]]
    except TypeError:
        return None


_NO_HEAD, _NO_OWNER, _NO_SIGNATURE = (dict.fromkeys(cols, "") for cols in (HEAD, OWNER, SIGNATURE))


def _shaped(text: str, parts: tuple[str, ...], bare: bool = False) -> dict | None:
    """The record of a form whose shapes are known, or can be learned; else None.
    A bare one has no columns that its shapes have no texts for."""
    xml = isolate(text)
    if not xml.startswith("<ownershipDocument") or not xml.isascii() or "]]>" in xml:
        return None
    raw = xml.encode()
    if len(raw.translate(None, _ODD)) != len(raw):
        return None
    clean = str.strip
    if "&" in xml:
        if not _ENTITIES.keys() >= set(_ENTITY.findall(xml)):
            return None
        clean = _unescaped
    at, end = 0, len(xml)
    key: list[int | tuple[str, ...]] = []
    shapes: list[tuple | list[str]] = []
    groups: list[str] = []
    rows: dict[str, list[dict]] = {name: [] for name in ROWS}
    run: list[str] | None = None
    count = 0
    while at < end:
        start = _ROW_TAG.match(xml, at)
        tag = start[1] if start else ""
        known = _SHAPES[tag]
        for i, shape in enumerate(known):
            hit = shape[1].match(xml, at)
            if hit is not None:
                if i:
                    known[i - 1], known[i] = shape, known[i - 1]
                break
        else:
            if len(known) >= _SHAPES_MOST:
                return None
            if tag:
                stop = xml.find(f"</{tag}>", at) + len(tag) + 3
            else:
                following = _ROW_TAG.search(xml, at)
                stop = following.start() if following else end
            learned = _shape(xml[at:stop], tag) if stop > at else None
            hit = learned[1].match(xml, at) if learned else None
            if hit is None:
                return None
            shape = learned
            known.append(shape)
        at = hit.end()
        while at < end and xml[at].isspace():
            at += 1
        if not tag:
            run = None
            key.append(shape[0])
            shapes.append(shape)
            groups += hit.groups()
            continue
        if run is None:
            run, count = [], 0
            shapes.append(run)
            key.append(())
        if tag not in run:
            run.append(tag)
            key[-1] = tuple(run)
        count += 1
        name = _LIST[tag]
        if name in parts:
            own = hit.groups()
            row = {} if bare else dict(_EMPTY[name])
            row["sequence_key"] = count
            for c, j in shape[3]:
                row[c] = clean(own[j])
            for c, js in shape[4]:
                row[c] = _ids(tuple(own[j] for j in js))
            rows[name].append(row)
    which = tuple(key)
    if which not in _PLANS:
        if len(_PLANS) >= _PLANS_MOST:
            return None
        _PLANS[which] = _plan(shapes)
    plan = _PLANS[which]
    if plan is None:
        return None

    def filled(empty: dict[str, str], slots: list[tuple[str, int]]) -> dict:
        texts = {c: clean(groups[j]) for c, j in slots}
        return texts if bare else empty | texts

    head, owners, notes, signatures = plan
    out: dict = filled(_NO_HEAD, head) if "head" in parts else {}
    if "owners" in parts:
        out["owners"] = [filled(_NO_OWNER, o) for o in owners]
    out |= {name: found for name, found in rows.items() if name in parts}
    if "footnotes" in parts:
        out["footnotes"] = {groups[i].upper().replace("F", ""): clean(groups[j]) if j >= 0 else "" for i, j in notes}
    if "signatures" in parts:
        out["signatures"] = [filled(_NO_SIGNATURE, x) for x in signatures]
    return out


def record(content: bytes | str | None, parts: tuple[str, ...] = PARTS, bare: bool = False) -> dict | None:
    """The nested record of a form, all values as text; None if unreadable.
    With ``parts`` only these are read; a bare record may lack columns without a text."""
    text = content if isinstance(content, str) else bytes(content or b"").decode("utf-8", "ignore")
    shaped = _shaped(text, parts, bare)
    return _whole(text, parts) if shaped is None else shaped


def _whole(text: str, parts: tuple[str, ...]) -> dict | None:
    """The same by an XML reader, whatever the form is like."""
    root = root_of(text)
    if root is None:
        return None
    out: dict = _texts(root, HEAD) if "head" in parts else {}
    if "owners" in parts:
        out["owners"] = [_texts(o, OWNER) for o in root.findall("reportingOwner")]
    for name, (table, row, _) in ROWS.items():
        if name in parts:
            home = root.find(table)
            # One counter runs over both kinds of rows of a table.
            kinds = [r for t, r, _ in ROWS.values() if t == table]
            known = [e for e in (home if home is not None else ()) if e.tag in kinds]
            out[name] = [_row(name, i, e) for i, e in enumerate(known, 1) if e.tag == row]
    if "footnotes" in parts:
        notes = root.find("footnotes")
        out["footnotes"] = {
            (f.get("id") or "").upper().replace("F", ""): "".join(f.itertext()).strip() for f in (notes.findall("footnote") if notes is not None else ())
        }
    if "signatures" in parts:
        out["signatures"] = [_texts(s, SIGNATURE) for s in root.findall("ownerSignature")]
    return out


def _struct(cols: dict, refs: bool) -> S.StructType:
    fields = [S.StructField(c, S.StringType()) for c in cols]
    if refs:
        fields = [S.StructField("sequence_key", S.LongType()), *fields, *(S.StructField(f"{c}_fn", S.ArrayType(S.StringType())) for c in cols)]
    return S.StructType(fields)


def schema(parts: tuple[str, ...] = PARTS) -> S.StructType:
    out = [S.StructField(c, S.StringType()) for c in HEAD] if "head" in parts else []
    lists = {"owners": _struct(OWNER, False)} | {n: _struct(cols, True) for n, (_, _, cols) in ROWS.items()}
    out += [S.StructField(n, S.ArrayType(kind)) for n, kind in lists.items() if n in parts]
    if "footnotes" in parts:
        out.append(S.StructField("footnotes", S.MapType(S.StringType(), S.StringType())))
    if "signatures" in parts:
        out.append(S.StructField("signatures", S.ArrayType(_struct(SIGNATURE, False))))
    return S.StructType(out)


def _arrow(kind: S.DataType) -> pa.DataType:
    if isinstance(kind, S.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    if isinstance(kind, S.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, S.MapType):
        return pa.map_(_arrow(kind.keyType), _arrow(kind.valueType))
    return pa.int64() if isinstance(kind, S.LongType) else pa.string()


#: Forms whose records are held at once.
_FORMS = 500


def _read(df: DataFrame, key: str, content: str, kind: S.DataType, value: Callable[[bytes | str | None], object]) -> DataFrame:
    """``(key, r)``, a value for each form.  As a map over batches it is worked
    out once, whatever is selected and filtered from it."""
    arrow = _arrow(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _FORMS):
                some = batch.slice(at, _FORMS)
                values = pa.array([value(c.as_py()) for c in some.column(1)], arrow)
                yield pa.RecordBatch.from_arrays([some.column(0), values], names=[key, "r"])

    return df.select(key, content).mapInArrow(run, S.StructType([df.schema[key], S.StructField("r", kind)]))


def parsed(df: DataFrame, key: str, content: str, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """``(key, r)`` with the parts asked for of the nested record, null for what
    no reader can make sense of."""

    def value(c: bytes | str | None) -> dict | None:
        r = record(c, parts)
        if r is not None and "footnotes" in r:
            r["footnotes"] = list(r["footnotes"].items())
        return r

    return _read(df, key, content, schema(parts), value)


def records(df: DataFrame, key: str, content: str) -> DataFrame:
    """The records that could be read."""
    return parsed(df, key, content).where("r IS NOT NULL")


def _is_form(content: bytes | str | None) -> str | None:
    return None if record(content, ()) is None else ""


def errors(df: DataFrame, key: str, content: str) -> DataFrame:
    """A row that says so for each form that could not."""
    return error_rows(_read(df, key, content, S.StringType(), _is_form).where("r IS NULL"), key, "unreadable form")


def _typed(name: str, c: Column) -> Column:
    if name.endswith("_fn"):
        return F.array_join(c, ",")
    if name in NUMBERS:
        return N.to_float(c)
    if name in DATES:
        return D.strict_date(c)
    if name in FLAGS:
        return V.xml_bool(c)
    return F.nullif(c, F.lit("")) if name != "security_title" else c


def tables(df: DataFrame, key: str, content: str, folder: str | None = None) -> dict[str, DataFrame]:
    """The eight tables of ownership filings, by name, and ``ownership_error``.

    With a ``folder``, forms are parsed once: their records are written there
    and all tables read them; else each table parses its part when it is used.
    """
    every = None
    if folder is not None:
        every = parsed(df, key, content)
        every.write.option("compression", "zstd").parquet(folder)
        every = df.sparkSession.read.schema(every.schema).parquet(folder)

    def of(*parts: str) -> DataFrame:
        return (parsed(df, key, content, parts) if every is None else every).where("r IS NOT NULL")

    first_owner = F.coalesce(N.to_int(F.try_element_at("r.owners", F.lit(1)).getField("rptowner_cik")), F.lit(0).cast("long"))
    head = [F.when(F.col("r.issuer_cik") != "", T.zfill("r.issuer_cik")).alias("issuer_cik")]
    head += [_typed(c, F.col(f"r.{c}")).alias(c) for c in HEAD if c != "issuer_cik"]
    out = {"ownership_submission": of("head").select(key, *head)}
    owners = of("owners").select(key, F.explode("r.owners").alias("o"))
    out["ownership_reporting_owner"] = owners.select(
        key, *((N.to_int("o.rptowner_cik") if c == "rptowner_cik" else _typed(c, F.col(f"o.{c}"))).alias(c) for c in OWNER)
    )
    for name, (_, _, cols) in ROWS.items():
        rows = of("owners", name).select(key, first_owner.alias("rptowner_cik"), F.explode(f"r.{name}").alias("x"))
        wanted = [*cols, *(f"{c}_fn" for c in cols)]
        table = f"ownership_{name.removesuffix('s')}"
        out[table] = rows.select(key, F.col("x.sequence_key").alias("sequence_key"), "rptowner_cik", *(_typed(c, F.col(f"x.{c}")).alias(c) for c in wanted))
    out["ownership_footnote"] = of("footnotes").select(key, F.explode("r.footnotes").alias("footnote_id", "footnote_text"))
    signed = of("signatures").select(key, F.explode("r.signatures").alias("s"))
    signed = signed.select(key, F.col("s.signature_name").alias("signature_name"), D.strict_date("s.signature_date").alias("signature_date"))
    out["ownership_signature"] = signed.where("signature_name <> '' AND signature_date IS NOT NULL")
    out["ownership_error"] = errors(df, key, content) if every is None else error_rows(every.where("r IS NULL"), key, "unreadable form")
    return out


#: What a list of the nested record is called, and the table it comes from.
LISTS = {
    "non_derivative_transactions": "ownership_nonderiv_transaction", "non_derivative_holdings": "ownership_nonderiv_holding",
    "derivative_transactions": "ownership_deriv_transaction", "derivative_holdings": "ownership_deriv_holding",
}
_SHORT = {"transaction_shares": "shares", "transaction_price_per_share": "price"}


def sentence(kind: Column, code: Column, title: Column, refs: Column, notes: Column) -> Column:
    """What a row says: what was done, under which code, and its notes."""
    verb = F.when(kind == "A", "acquired").when(kind == "D", "disposed").otherwise("held")
    coded = F.when(F.coalesce(code, F.lit("")) != "", F.concat(F.lit(" (Code "), code, F.lit(")"))).otherwise("")
    known = F.filter(F.array_distinct(refs), lambda i: F.try_element_at(notes, i).isNotNull())
    noted = F.array_join(F.transform(known, lambda i: F.concat(F.lit(" [Note "), i, F.lit(": "), F.try_element_at(notes, i), F.lit("]"))), "")
    return F.concat(F.coalesce(F.nullif(title, F.lit("")), F.lit("Security")), F.lit(" was "), verb, coded, F.lit("."), noted)


def _filled(name: str, c: Column) -> Column:
    """A table's value in a nested record, where nothing is missing."""
    if name.endswith("_fn"):
        return F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")
    if name in NUMBERS:
        return F.coalesce(c, F.lit(0.0))
    if name in FLAGS:
        return F.coalesce(c, F.lit(False))
    if name.endswith("_cik"):
        return T.zfill(F.coalesce(c.cast("string"), F.lit("")))
    return F.coalesce(c.cast("string"), F.lit(""))


def _item(name: str, values: dict[str, Column], notes: Column) -> Column:
    """A row of a list of the nested record, from its table's values."""
    refs = F.flatten(F.array(*(_filled(c, v) for c, v in values.items() if c.endswith("_fn"))))
    done = [values.get(c, F.lit("")) for c in ("transaction_acquired_disposed_code", "transaction_code")]
    said = sentence(*done, values["security_title"], refs, notes)
    short = lambda c: _SHORT.get(c, f"{_SHORT[c[:-3]]}_fn" if c[:-3] in _SHORT and c.endswith("_fn") else c)
    label = "transaction_summary" if name.endswith("transactions") else "holding_summary"
    return F.struct(*(_filled(c, v).alias(short(c)) for c, v in values.items()), said.alias(label))


def _ordered(items: Column) -> Column:
    """Structs of an order and an item: the items in that order."""
    return F.transform(F.array_sort(items), lambda x: x["_x"])


_ISSUER = ("issuer_cik", "issuer_name", "issuer_trading_symbol", "issuer_foreign_trading_symbol", "schema_version")


def _heading(values: dict[str, Column]) -> list[Column]:
    issuer = F.struct(*(_filled(c, values[c]).alias(c) for c in _ISSUER))
    return [issuer.alias("issuer"), *(_filled(c, values[c]).alias(c) for c in HEAD if c not in _ISSUER)]


def nested_records(t: dict[str, DataFrame], key: str) -> DataFrame:
    """``(key, record)``: the tables of filings as one nested JSON record each.

    Missing texts are empty, missing numbers 0.0, ids padded, references lists;
    every row carries its sentence.  Lists are in the order of their rows.
    """

    def listed(df: DataFrame, name: str, item: Column, order: str) -> DataFrame:
        return df.groupBy(key).agg(_ordered(F.collect_list(F.struct(F.col(order).alias("_o"), item.alias("_x")))).alias(name))

    notes = t["ownership_footnote"].groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("footnote_id", "footnote_text"))).alias("footnotes"))
    empty = F.create_map().cast("map<string,string>")
    out = t["ownership_submission"].join(notes, key, "left").withColumn("footnotes", F.coalesce("footnotes", empty))
    owner = t["ownership_reporting_owner"]
    out = out.join(listed(owner, "reporting_owners", F.struct(*(_filled(c, F.col(c)).alias(c) for c in OWNER)), "rptowner_cik"), key, "left")
    for name, table in LISTS.items():
        rows = t[table].join(notes, key, "left").withColumn("footnotes", F.coalesce("footnotes", empty))
        cols = [c for c in t[table].columns if c not in (key, "rptowner_cik", "sequence_key")]
        out = out.join(listed(rows, name, _item(name, {c: F.col(c) for c in cols}, F.col("footnotes")), "sequence_key"), key, "left")
    signature = F.struct(F.col("signature_name"), F.col("signature_date").cast("string").alias("signature_date"))
    out = out.join(listed(t["ownership_signature"], "signatures", signature, "signature_name"), key, "left")
    arrays = [c for c in ("reporting_owners", *LISTS, "signatures")]
    filled = [F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)).alias(c) for c in arrays]
    return out.select(key, F.to_json(F.struct(*_heading({c: F.col(c) for c in HEAD}), *filled, "footnotes")).alias("record"))


def nested(df: DataFrame, key: str, content: str, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """The same of filings that have a key each, without moving their rows."""
    return nested_structs(df, key, content, parts).select(key, F.to_json("r").alias("record"))


def nested_structs(df: DataFrame, key: str, content: str, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """``(key, r)``: the nested records as structs; a form's rows get their tables'
    types where it was parsed.  With ``parts`` (notes are always read) the record
    has only these."""
    read = parsed(df, key, content, tuple(p for p in PARTS if p in parts or p == "footnotes")).where("r IS NOT NULL")
    notes, fields = F.col("r.footnotes"), []
    if "head" in parts:
        cik = F.when(F.col("r.issuer_cik") != "", T.zfill("r.issuer_cik"))
        fields += _heading({c: cik if c == "issuer_cik" else _typed(c, F.col(f"r.{c}")) for c in HEAD})
    if "owners" in parts:

        def owner(o: Column) -> Column:
            values = {c: N.to_int(o[c]) if c == "rptowner_cik" else _typed(c, o[c]) for c in OWNER}
            return F.struct(values["rptowner_cik"].alias("_o"), F.struct(*(_filled(c, v).alias(c) for c, v in values.items())).alias("_x"))

        fields.append(_ordered(F.transform("r.owners", owner)).alias("reporting_owners"))

    def listed(name: str, rows: str) -> Column:
        cols = [*ROWS[rows][2], *(f"{c}_fn" for c in ROWS[rows][2])]
        return F.transform(f"r.{rows}", lambda x: _item(name, {c: _typed(c, x[c]) for c in cols}, notes)).alias(name)

    fields += [listed(n, rows) for n, table in LISTS.items() if (rows := table.removeprefix("ownership_") + "s") in parts]
    if "signatures" in parts:
        signed = F.transform("r.signatures", lambda s: F.struct(s.signature_name.alias("signature_name"), D.strict_date(s.signature_date).cast("string").alias("signature_date")))
        signed = F.filter(signed, lambda s: (s.signature_name != "") & s.signature_date.isNotNull())
        fields.append(_ordered(F.transform(signed, lambda s: F.struct(s.signature_name.alias("_o"), s.alias("_x")))).alias("signatures"))
    if "footnotes" in parts:
        fields.append(notes.alias("footnotes"))
    return read.select(key, F.struct(*fields).alias("r"))


_SECURITY, _OWNED, _WORTH = ("Security", "security_title"), ("Owned After", "shares_owned_following_transaction"), ("Value After", "value_owned_following_transaction")
_NATURE, _SUMMARY, _CONVERSION = ("Nature", "@nature"), ("Summary", "@none"), ("Conv/Exer Price", "conversion_or_exercise_price")
_UNDERLYING = (
    ("Exercise Date", "exercise_date"), ("Expiry Date", "expiration_date"), ("Underlying Title", "underlying_security_title"),
    ("Underlying Shares", "underlying_security_shares"), ("Underlying Value", "underlying_security_value"),
)
#: Markdown tables: heading, then list, title and columns as title and field
#: (fixed values).
_LAYOUT = (
    ("Table I - Non-Derivative Securities", (
        ("nonderiv_transactions", "Transactions", (
            _SECURITY, ("Date", "transaction_date"), ("Deemed Exec", "deemed_execution_date"), ("Code", "transaction_code"),
            ("Form Type", "transaction_form_type"), ("A/D", "transaction_acquired_disposed_code"), ("Equity Swap", "equity_swap_involved"),
            ("Timeliness", "transaction_timeliness"), ("Shares", "transaction_shares"), ("Price", "transaction_price_per_share"),
            ("Total Value", "transaction_total_value"), _OWNED, _WORTH, _NATURE,
        )),
        ("nonderiv_holdings", "Holdings", (_SECURITY, _OWNED, _WORTH, _NATURE, _SUMMARY)),
    )),
    ("Table II - Derivative Securities", (
        ("deriv_transactions", "Transactions", (
            _SECURITY, _CONVERSION, ("Date", "transaction_date"), ("Code", "transaction_code"), ("A/D", "transaction_acquired_disposed_code"),
            ("Shares", "@amount"), *_UNDERLYING, _OWNED, _WORTH, _NATURE, _SUMMARY,
        )),
        ("deriv_holdings", "Holdings", (_SECURITY, _CONVERSION, *_UNDERLYING, _OWNED, _WORTH, _NATURE, _SUMMARY)),
    )),
)
NONE, NULL = "[NONE]", "[NULL]"


def _cell(row: dict, field: str) -> str:
    if field == "@none":
        return NONE
    if field == "@nature":
        direct, nature = row["direct_or_indirect_ownership"], row["nature_of_ownership"]
        parts = [direct, f"({nature})" if nature else ""]
        parts += ["".join(f"[^{i}]" for i in row[c]) for c in ("direct_or_indirect_ownership_fn", "nature_of_ownership_fn")]
        return " ".join(p for p in parts if p)
    if field == "@amount":
        field = "transaction_shares" if row["transaction_shares"] else "transaction_total_value"
    text, refs = row[field], row[f"{field}_fn"]
    if not refs:
        return text
    marks = "".join(f"[^{i}]" for i in refs)
    return f"{text} {marks}" if text else marks


def markdown_of(content: bytes | str | None, accession: str | None = None) -> str:
    """A form as Markdown: front matter, owners, tables, remarks, notes."""
    r = record(content)
    if r is None:
        return "Error parsing XML"
    front = {"accession": accession, "form": r["form_type"], "schema": r["schema_version"], "period": r["period_of_report"]}
    front |= {"issuer": r["issuer_name"], "cik": r["issuer_cik"], "symbol": r["issuer_trading_symbol"] or r["issuer_foreign_trading_symbol"]}
    lines = ["---", *(f"{k}: {v}" for k, v in front.items() if v), "---", "", "## Reporting Owners"]
    for o in r["owners"]:
        place = ", ".join(p for p in (o["city"], o["state"], o["zip"]) if p)
        roles = [t for flag, t in (("is_director", "Director"), ("is_officer", f"Officer: {o['officer_title']}"), ("is_10pctowner", "10% Owner"), ("is_other", f"Other: {o['other_text']}")) if o[flag].lower() in ("1", "true")]
        lines += [f"### {o['rptowner_name']} ({o['rptowner_cik']})", f"* **Address:** {', '.join(p for p in (o['street1'], o['street2'], place) if p) or NULL}", f"* **Position(s):** {', '.join(roles) or 'No roles specified'}"]
    for title, parts in _LAYOUT:
        if any(r[name] for name, _, _ in parts):
            lines += ["", f"## {title}"]
        for name, heading, cols in parts:
            if r[name]:
                lines += [f"### {heading}", f"| {' | '.join(c for c, _ in cols)} |", f"| {' | '.join(':---' for _ in cols)} |"]
                lines += [f"| {' | '.join(_cell(row, f) for _, f in cols)} |" for row in r[name]]
    notes = [f"[^{i}]: {t}" for i, t in r["footnotes"].items()]
    lines += ["", "## Filing Remarks", r["remarks"] or NULL, "", "## Footnotes", *(notes or [NULL]), "", "## Signatures", "| Signature Name | Date |", "| :--- | :--- |"]
    return "\n".join(lines + [f"| {s['signature_name']} | {s['signature_date']} |" for s in r["signatures"]])


@arrow_udf("string")
def markdown(content: pd.Series) -> pd.Series:
    return content.map(markdown_of)


#: What an empty text stands for in a record with numbers and flags.
_NOTHING = {c: 0.0 if c in NUMBERS else False if c in FLAGS else "" for cols in (HEAD, OWNER, *(c for _, _, c in ROWS.values())) for c in cols}


def _number(v: str) -> float:
    try:
        return float(v.replace(",", "") or 0)
    except ValueError:
        return 0.0


def _valued(row: dict) -> dict:
    out = {}
    for c, v in row.items():
        if c not in _NOTHING:
            continue
        if not v:
            out[c] = _NOTHING[c]
        elif c in NUMBERS:
            out[c] = _number(v)
        else:
            out[c] = v.lower() in ("1", "true", "yes", "y") if c in FLAGS else v
    return out


def ground_truth(content: bytes | str | None, parts: tuple[str, ...] = PARTS) -> dict:
    """A form's record with numbers as numbers (missing: 0.0) and flags; with
    ``parts`` only these."""
    r = record(content, parts)
    if r is None:
        return {}
    out = _valued({c: r[c] for c in HEAD}) if "head" in parts else {}
    out |= {name: [_valued(x) for x in r[name]] for name in ("owners", *ROWS) if name in parts}
    return out | {name: r[name] for name in ("signatures", "footnotes") if name in parts}


@arrow_udf("string")
def ground_truth_json(content: pd.Series) -> pd.Series:
    return content.map(lambda c: json.dumps(ground_truth(c)))


def ground_truths(df: DataFrame, key: str, content: str, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """``(key, r)``: the records of forms that can be read, or ``parts`` of them, as JSON."""
    return _read(df, key, content, S.StringType(), lambda c: json.dumps(g) if (g := ground_truth(c, parts)) else None).where("r IS NOT NULL")


def rationale(kind: str, code: str | None, title: str | None, refs: list[str], notes: dict[str, str]) -> str:
    """A row in a sentence: what was done, under which code, with its notes."""
    verb = {"A": "acquired", "D": "disposed"}.get(kind, "held")
    text = f"{title or 'Security'} was {verb}" + (f" (Code {code})" if code else "") + "."
    return text + "".join(f" [Note {i}: {notes[i]}]" for i in dict.fromkeys(refs) if i in notes)
