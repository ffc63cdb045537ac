"""The report's text. Everything it shows is counted or cut to a preview in Spark; what reaches the driver has a fixed length."""

from __future__ import annotations

import datetime as dt
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Rows of a map's table, of lists of buyers and vendors, and names of a run in the index.
PREVIEW, LISTED, NAMES = 25, 10, 5
#: Where the tool check can come out, and how the report says it.
STATUS_TEXT = {
    "present": "present", "absent": "absent", "absent_unverified": "not seen, though a loader on the page could still add it", "unknown": "not known (no readable page)",
}
Log = list[tuple[str, str, int, str]]


def place_of(address: Any) -> str:
    return ", ".join(x for x in (address["city"], address["region"], address["country"]) if x) if address else ""


def sources_text(log: Log) -> str:
    return ", ".join(f"{name} {count}" if status == "ok" else f"{name} failed" for name, status, count, _ in log) or "none"


def failures(log: Log) -> list[str]:
    return [f"- Source failed ({name}): {error.rstrip('.')}." for name, status, _, error in log if status != "ok"]


def coverage_text(census: dict[str, Any] | None, found: int) -> str | None:
    """How many of the counted establishments the list covers, or why that can't be told.

    census: status, error, year, codes, counties, total, under_20.
    """
    if not census:
        return None
    if census.get("status", "ok") != "ok":
        return f"- Coverage: not checked ({str(census.get('error') or 'no reason given').rstrip('.')})."
    total, small = census.get("total") or 0, census.get("under_20") or 0
    if not total:
        return f"- Coverage: the census counts no establishment in {', '.join(census.get('codes') or [])}."
    gap = max(0, total - found)
    return (
        f"- Coverage: {found} listed against {total} establishments in {', '.join(census.get('codes') or [])} ({census.get('year')}, {census.get('counties')} counties), "
        f"{100 * found / total:.0f} percent, {gap} short; {small} of them have under 20 employees. Establishments are places, not companies."
    )


def tools_text(accounts: DataFrame) -> str | None:
    """The tool check over all accounts: of each category how often each status came out."""
    rows = accounts.select(F.explode("tech_status").alias("category", "status")).groupBy("category", "status").agg(F.count(F.lit(1)).alias("n")).collect()  # categories times four
    if not rows:
        return None
    parts = []
    for category in sorted({r["category"] for r in rows}):
        n = {r["status"]: r["n"] for r in rows if r["category"] == category}
        parts.append(f"{category}: " + ", ".join(f"{n[s]} {STATUS_TEXT[s]}" for s in STATUS_TEXT if n.get(s)))
    return "- Tools: " + "; ".join(parts) + "."


def tool_names(labels: list[str] | None) -> str:
    """Vendors of "category:vendor" labels as words."""
    return ", ".join(x.partition(":")[2].replace("_", " ") for x in labels or []) or "none seen"


def size_text(row: Any) -> str:
    if row["employees"] is not None:
        return f"{row['employees']} employee{'s' if row['employees'] != 1 else ''}"
    return "" if row["size_band"] in (None, "unknown") else row["size_band"]


def brief(row: Any) -> str:
    """One judged account in Markdown: place, reasons, timing, risks, whom to reach, and the draft as a quotation."""
    have = row.asDict()
    head = " · ".join(x for x in (place_of(row["address"]), row["website"]) if x)
    lines = [f"### {row['name']} ({row['fit']}, {row['fit_score']} of 5)", ""]
    lines += [f"- {head}"] if head else []
    lines.append(f"- What they do: {row['what_they_do']}")
    lines += [f"- Fits: {w['text']}" + (f" [{w['context_id']}]" if w["context_id"] else "") for w in have.get("why_fit") or []]
    timing = have.get("judge_signals") or have.get("signals") or []
    lines += [f"- Timing: [{s['detail']}]({s['url']})" if s["url"] else f"- Timing: {s['detail']}" for s in timing]
    lines += [f"- Risk: {r}" for r in have.get("risks") or []]
    lines += [f"- Reach: {have['contact_role']}"] if have.get("contact_role") else []
    if draft := have.get("draft"):
        lines += [f"- Draft ({draft['channel'] or 'email'}, unsent):", ""]
        lines += [f"  > Subject: {draft['subject']}", "  >"] if draft["subject"] else []
        lines += [f"  > {x}".rstrip() for x in (draft["body"] or "").splitlines()]
    return "\n".join(lines)


def market_table(rows: list[Any], total: int) -> list[str]:
    """The first accounts of a map; a column of tools where the search asked for any."""
    tools = any(r["tech_status"] for r in rows)
    heads = ["#", "Company", "Place", "Size", "Website", "Score", "Signals", *(["Tools"] if tools else [])]
    out = ["| " + " | ".join(heads) + " |", "|---" * len(heads) + "|"]
    for r in rows:
        cells = [r["place"], r["name"], place_of(r["address"]), size_text(r), r["domain"] or "", r["score"], "; ".join(s["detail"] for s in r["signals"] or [])]
        cells += [tool_names(r["site"]["tech"] if r["site"] else None)] if tools else []
        out.append("| " + " | ".join(map(str, cells)) + " |")
    return [*out, *([f"\n{len(rows)} of {total} are shown; the export holds all."] if total > len(rows) else [])]


def buyers_part(rows: DataFrame, checked: int, log: Log | None = None) -> list[str]:
    """Who buys: listed companies with purchases, the largest buyers, and vendors that aren't listed.

    rows: labelled purchases. Lists are cut to LISTED rows in Spark, and to the first three names in each.
    """
    from . import buyers as B

    own = B.by_company(rows)
    seen = own.count()
    lines = ["", "### Who buys", "", *([f"Purchase records: {sources_text(log)}.", *failures(log)] if log else [])]
    lines += [f"Listed companies with purchases: {seen} of {checked}.", ""]
    shown = lambda df, *cols: df.orderBy(F.desc("total"), df.columns[0]).limit(LISTED).select(T.money("total").alias("money"), "count", *cols).collect()
    for r in shown(own, "listed_company", F.slice("buyers", 1, 3).alias("some")):
        lines.append(f"- {r['listed_company']}: {r['money']} over {r['count']} purchases, from {'; '.join(r['some'])}")
    if top := shown(B.top_buyers(rows), "label", F.slice("vendors", 1, 3).alias("some"), F.size("vendors").alias("n_vendors")):
        lines += ["", "Buyers:", *[f"- {b['label']}: {b['money']} over {b['count']} purchases, to {', '.join(b['some'])}" + (f" +{b['n_vendors'] - 3}" if b["n_vendors"] > 3 else "") for b in top]]
    if others := shown(B.other_vendors(rows), "vendor"):
        lines += ["", "Vendors they pay that aren't listed:", *[f"- {v['vendor']}: {v['money']} over {v['count']} purchases" for v in others]]
    return [*lines, "", "Only public purchases are in these records; a company without any may still sell."]


def section(label: str, goal: str, funnel: str, delivered: DataFrame, purchases: DataFrame | None = None, *, judged: bool = True, target: int | None = None, notes: list[str | None] | None = None, log: Log | None = None, rejected: DataFrame | None = None, purchase_log: Log | None = None, preview: int = PREVIEW) -> str:
    """One search: its goal, where its companies came from and went, notes, and briefs (a judged top-n search) or a table."""
    lines = [f"## {label}", "", f"Goal: {f'the best {target}' if target and goal == 'top_n' else 'the best' if goal == 'top_n' else 'the whole market'}.", ""]
    lines += [f"Sources: {sources_text(log)}.", ""] if log else []
    lines += [funnel, "", *[n for n in notes or [] if n], *(failures(log) if log else [])]
    if log and all(x[1] != "ok" for x in log):
        return "\n".join([*lines, "", "Nothing could be searched: every source failed."]) + "\n"
    total = delivered.count()
    rows = delivered.orderBy("place").limit(preview).collect()  # a preview of fixed length
    if goal == "top_n" and target and total < target:
        lines += ["", f"{total} of {target}: no more companies cleared the filters" + (" and the judge." if judged else ".")]
    if not rows:
        lines += ["", "Nothing qualified."]
    elif goal == "top_n" and judged:
        lines += ["", *[brief(r) + "\n" for r in rows]]
    else:
        lines += ["", *(["Not judged: in the order of the filters' score.", ""] if goal == "top_n" else []), *market_table(rows, total)]
    if goal != "top_n" and rejected is not None:
        out = rejected.orderBy("rank").limit(preview).collect()
        lines += ["", f"Removed by the judge ({rejected.count()}):", *[f"- {r['name']}: {r['reason']}" for r in out]] if out else []
    if purchases is not None:
        lines += buyers_part(purchases, total, purchase_log)
    return "\n".join(lines) + "\n"


def summary_line(label: str, goal: str, delivered: int, target: int | None = None, failed: bool = False) -> str:
    if failed:
        return f"- {label}: not searched"
    return f"- {label}: {delivered} of {target}" if goal == "top_n" and target else f"- {label}: {delivered} companies"


def report(run_date: str, sections: list[str], note: str = "", summary: list[str] | None = None, cost: str | None = None) -> str:
    """The whole report: a summary, the sections, and what the judge cost as far as it is known."""
    day = dt.date.fromisoformat(run_date).strftime("%A")
    head = [f"# Market report {run_date} ({day})", "", "Nothing here was sent to anyone.", ""]
    head += ["## Summary", "", *summary, ""] if summary else []
    return "\n".join(head) + "\n" + "\n".join(sections) + (f"\n{note}\n" if note else "") + f"\n---\nJudge's cost: {cost or 'not recorded'}.\n"


# ---------------------------------------------------------------- the index of runs

INDEX_HEAD = ["# Runs", "", "| Date | Searches | Results |", "|---|---|---|"]


def index_row(run_date: str, cells: dict[str, str]) -> str:
    """One run's row: of each search the first names, or that there were none."""
    return f"| {run_date} | {len(cells)} | {' · '.join(f'{k}: {v or 'none'}' for k, v in cells.items())} |"


def upsert_index(path: Path, run_date: str, row: str) -> None:
    """The day's row replaced if there is one, else added at the end; a new file gets its head first."""
    lines = path.read_text(encoding="utf-8").splitlines() if path.is_file() else list(INDEX_HEAD)
    at = [i for i, line in enumerate(lines) if line.startswith(f"| {run_date} |")]
    lines = [row if i in at[:1] else line for i, line in enumerate(lines)] if at else [*lines, row]
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
