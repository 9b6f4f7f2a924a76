"""Institutional holdings reports: two XML blocks to a record of rows."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd

from ..functions.udf import arrow_udf

FIELDS = {
    "issuer": "nameOfIssuer", "class": "titleOfClass", "cusip": "cusip", "value": "value",
    "shares": "shrsOrPrnAmt/sshPrnAmt", "sh_type": "shrsOrPrnAmt/sshPrnAmtType", "discretion": "investmentDiscretion",
}
HOLDING = "struct<" + ", ".join(f"{c}: string" for c in [*FIELDS, "ticker"]) + ">"
REPORT = f"struct<form_type: string, manager_cik: string, manager_name: string, period_of_report: string, holdings: array<{HOLDING}>, error: string>"


def _plain(xml: str) -> ET.Element:
    root = ET.fromstring(xml.strip().encode("utf-8", "ignore"))
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    return root


def _any(root: ET.Element, *paths: str) -> str:
    return next((t.strip() for p in paths if (t := root.findtext(f".//{p}"))), "")


def report(content: str | bytes | None) -> dict:
    """The first block is the cover, the second the table; what cannot be
    read is named in ``error``."""
    text = content if isinstance(content, str) else bytes(content or b"").decode("utf-8", "ignore")
    blocks = re.findall(r"(?s)<(?:XML|xml)>(.*?)</(?:XML|xml)>", text) or [text]
    out = {"form_type": "13F", "manager_cik": "", "manager_name": "", "period_of_report": "", "holdings": [], "error": None}
    try:
        cover = _plain(blocks[0])
        out["manager_cik"] = _any(cover, "credentials/cik", "managerCik")
        out["manager_name"] = _any(cover, "filingManager/name", "managerName")
        out["period_of_report"] = _any(cover, "periodOfReport")
        out["form_type"] = _any(cover, "submissionType") or "13F"
        for row in _plain(blocks[1]).iter("infoTable") if len(blocks) > 1 else ():
            out["holdings"].append({c: (row.findtext(p) or "").strip() for c, p in FIELDS.items()} | {"ticker": None})
    except ET.ParseError as e:
        out["error"] = str(e)
    return out


@arrow_udf(REPORT)
def holdings_report(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([report(c) for c in content], columns=["form_type", "manager_cik", "manager_name", "period_of_report", "holdings", "error"])


#: Columns of the table, as title and field (fixed values).
LAYOUT = (
    ("Name of Issuer", "issuer"), ("Title of Class", "class"), ("CUSIP", "cusip"), ("Value (x$1000)", "value"),
    ("Shares/Amt", "shares"), ("Type", "sh_type"), ("Investment Discretion", "discretion"),
)
NOTHING = "*No data found in information table or form is a Notice filing.*"


def to_markdown(content: str | bytes | None) -> str:
    """The report as Markdown: manager, period and the table, or that there is
    none."""
    r = report(content)
    manager = f"**Manager:** {r['manager_name']} (CIK: {r['manager_cik']})"
    lines = [f"# SEC Form {r['form_type']} Filing", manager, f"**Report Period:** {r['period_of_report']}", ""]
    if not r["holdings"]:
        return "\n".join([*lines, NOTHING])
    rows = [[title for title, _ in LAYOUT], [":---"] * len(LAYOUT), *([h[c] for _, c in LAYOUT] for h in r["holdings"])]
    return "\n".join([*lines, "### Information Table - Institutional Holdings", *(f"| {' | '.join(cells)} |" for cells in rows)])


@arrow_udf("string")
def holdings_markdown(content: pd.Series) -> pd.Series:
    return content.map(to_markdown)


__all__ = ["holdings_markdown", "holdings_report", "report", "to_markdown"]
