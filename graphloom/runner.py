"""Run query files and report: name, milliseconds, rows."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass
from pathlib import Path

from graphloom.engine import Engine

#: Endings of query files that a folder run takes.
ENDINGS = (".sq", ".srx", ".sparql", ".in")


@dataclass(frozen=True)
class Report:
    name: str
    milliseconds: float
    rows: int | None


def query_files(path: str) -> list[Path]:
    """One file, or the query files of a folder by name."""
    p = Path(path)
    return [p] if p.is_file() else sorted(f for f in p.glob("*") if f.suffix in ENDINGS)


def run_files(
    engine: Engine,
    path: str,
    count: bool = False,
    benchmark: bool = False,
    output: str | None = None,
    report: str | None = None,
    prefix: str = "",
    explain: bool = False,
    expand: bool = False,
) -> list[Report]:
    """Run every file in turn.

    count: only count rows. benchmark: run into no sink. output: a folder that gets a Parquet table
    per query. report: a file that gets a JSON line per query. explain: a .log file with algebra and
    plan beside each query, nothing is run. expand: full IRIs in results. The time is that of the
    query alone.
    """
    out = []
    for f in query_files(path):
        text, name = f.read_text(), prefix + f.stem
        if explain:
            f.with_suffix(".log").write_text(engine.explain(text) + "\n")
            continue
        rows: int | None = None
        began = time.perf_counter()
        df = engine.expanded(text) if expand else engine.query(text)
        if count:
            rows = df.count()
        elif benchmark or output is None:
            df.write.format("noop").mode("overwrite").save()
        else:
            df.write.mode("overwrite").parquet(f"{output.rstrip('/')}/{name}")
        took = (time.perf_counter() - began) * 1000
        if rows is None and output is not None and not benchmark:
            rows = engine.store.spark.read.parquet(f"{output.rstrip('/')}/{name}").count()
        out.append(Report(name, round(took, 1), rows))
        if report is not None:
            with open(report, "a") as log:
                log.write(json.dumps(asdict(out[-1])) + "\n")
    return out
