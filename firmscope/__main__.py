"""python -m firmscope [STAGE] --profile P --root OUT --date D [--search NAME] and what the stage reads.

Stages: discover (saved payloads to records), enrich (websites from --pages and --scripts), judge (what a judge would be
given; --dry-run shows sizes only), report (filters, decisions, purchases, exports and the report), run (all of them, the default).
`run` takes records from --records, if given, instead of the profile's sources.

Exit codes: 0 done, 1 bad profile or input, 2 decisions that don't have their shape, 3 no records for a search or all its
sources failed, 4 the judge's answers can't be read. A run goes on after 0 and 3 and ends with the highest code met.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path
from typing import Any

OK, BAD_INPUT, BAD_SHAPE, NO_RECORDS, BAD_JUDGE = 0, 1, 2, 3, 4
STAGES = ("discover", "enrich", "judge", "report")


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="firmscope", description="Rank companies from records by the rules of a profile.")
    p.add_argument("stage", nargs="?", choices=(*STAGES, "run"), default="run")
    for name in ("--profile", "--root", "--date"):
        p.add_argument(name, required=True)
    for name in ("--records", "--search", "--hits", "--pages", "--scripts", "--decisions", "--purchases", "--census", "--context"):
        p.add_argument(name)
    p.add_argument("--dry-run", action="store_true", help="judge: print sizes, ask nobody")
    return p.parse_args(argv)


class Stages:
    """The stages of one call; each returns its exit code and leaves its tables under the root."""

    def __init__(self, spark: Any, settings: Any, args: argparse.Namespace):
        from .plans import runs

        self.spark, self.settings, self.args, self.runs = spark, settings, args, runs
        self.names = [args.search] if args.search else settings.ordered(list(settings.searches))

    def discover(self) -> int:
        from .sources import registry

        code = OK
        for name in self.names:
            records, log, status = registry.discover(self.spark, list(self.settings[name].sources), self.settings[name].policy.region)
            print(f"{name}: {status}, " + ", ".join(f"{k} {n if s == 'ok' else s}" for k, s, n, _ in log), file=sys.stderr)
            self.runs.save_records(self.spark, records, log, self.args.root, name, self.args.date)
            code = max(code, NO_RECORDS if status == "failed" else OK)
        return code

    def enrich(self) -> int:
        if not self.args.pages:
            return OK
        pages = self.spark.read.schema("url string, html string, error string").json(self.args.pages)
        scripts = self.spark.read.schema("url string, body string").json(self.args.scripts) if self.args.scripts else None
        for name in self.names:
            records = self._records(name)
            if records is not None:
                if self.args.hits:
                    hits = self.spark.read.schema("record_id string, pos int, url string, title string").json(f"{self.args.hits}/{name}")
                    records = self.runs.with_websites(self.spark, records, hits, self.args.root, name, self.args.date)
                read, failed = self.runs.save_sites(self.spark, self.settings, name, records, pages, scripts, self.args.root, self.args.date)
                print(f"{name}: {read} sites read, {failed} failed", file=sys.stderr)
        return OK

    def _records(self, name: str) -> Any:
        from .sources.records import RECORD

        found = self.runs.saved_records(self.spark, self.args.root, name, self.args.date)
        if found is None and self.args.records:
            found = self.spark.read.schema(RECORD).json(f"{self.args.records}/{name}")
        return found

    def _census(self, name: str) -> dict[str, Any] | None:
        """What the saved answers of the census count, for a search that asks for coverage."""
        if not self.args.census or not self.settings[name].coverage:
            return None
        payloads = self.spark.read.text(f"{self.args.census}/{name}", wholetext=True).withColumnRenamed("value", "payload")
        return self.runs.census_counts(self.settings[name], payloads)

    def judge(self) -> int:
        if not self.args.dry_run:
            return OK  # who decides stands outside: see operators/judging.py; decisions come back by --decisions
        for name in self.names:
            records = self._records(name)
            if records is not None:
                for row in self.runs.judge_sizes(self.spark, self.settings, name, records, self.args.date):
                    print(f"{name}: batch {row['part']} of {row['parts']}: {row['accounts']} accounts, {row['characters']} characters")
        return OK

    def report(self) -> int:
        from pyspark.sql import functions as F

        from .operators import report
        from .operators.judging import saved_decisions
        from .plans.settings import SettingsError, context_headings

        decisions = None
        if self.args.decisions:
            found = saved_decisions(self.spark, self.args.decisions)
            bad = found.filter(F.size("faults") > 0).orderBy(F.array_contains("faults", "not JSON").desc(), "pos").select("pos", "faults").first()
            if bad:
                print(f"decision {bad['pos']}: {', '.join(bad['faults'])}", file=sys.stderr)
                return BAD_JUDGE if "not JSON" in bad["faults"] else BAD_SHAPE
            decisions = found.drop("faults")
        try:
            headings = context_headings(self.settings, self.args.context)
        except SettingsError as e:
            print(e, file=sys.stderr)
            return BAD_INPUT
        sections, summary, cells, code = [], [], {}, OK
        for name in self.names:
            records = self._records(name)
            log = self.runs.saved_log(self.spark, self.args.root, name, self.args.date)
            label, goal, target = self.settings[name].label, self.settings[name].goal, self.settings[name].target
            if records is None or records.isEmpty():
                print(f"{name}: no records", file=sys.stderr)
                code, cells[name] = NO_RECORDS, ""
                summary.append(report.summary_line(label, goal, 0, target, failed=bool(log) and all(x[1] != "ok" for x in log)))
                continue
            purchases = self.spark.read.json(f"{self.args.purchases}/{name}") if self.args.purchases else None
            done = self.runs.run_search(self.spark, self.settings, name, records, self.args.date, self.args.root, decisions, headings, purchases, log, self._census(name))
            print(f"{name}: {json.dumps(done.counts)}", file=sys.stderr)
            sections.append(done.text)
            summary.append(report.summary_line(label, goal, done.counts["delivered"], target))
            cells[name] = done.cell
        out = Path(self.args.root) / "reports"
        out.mkdir(parents=True, exist_ok=True)
        (out / f"{self.args.date}.md").write_text(report.report(self.args.date, sections, summary=summary), encoding="utf-8")
        report.upsert_index(Path(self.args.root) / "index.md", self.args.date, report.index_row(self.args.date, cells))
        return code


def main(argv: list[str] | None = None) -> int:
    args = _arguments(argv)
    from .plans.settings import SettingsError, load
    from .session import local_session

    try:
        settings = load(args.profile)
    except SettingsError as e:
        print(e, file=sys.stderr)
        return BAD_INPUT
    stages, worst = Stages(local_session(), settings, args), OK
    todo = [args.stage] if args.stage != "run" else [s for s in STAGES if s != "judge" and not (s == "discover" and args.records)]
    for name in todo:
        code = getattr(stages, name)()
        worst = max(worst, code)
        if code not in (OK, NO_RECORDS):
            break
    return worst


if __name__ == "__main__":
    sys.exit(main())
