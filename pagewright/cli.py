"""python -m pagewright.cli PATH...: files to compact text by a local Spark session."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright import __version__, events
from pagewright.errors import ConfigError
from pagewright.operators import stats, steps
from pagewright.operators.steps import default_pipeline
from pagewright.options import home, load_config, with_overrides


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagewright", description=__doc__)
    p.add_argument("paths", nargs="+")
    p.add_argument("--out", help="folder for the results; without it they are printed")
    p.add_argument("--format", choices=("md", "txt", "json"))
    p.add_argument("--recursive", action="store_true")
    p.add_argument("--config")
    p.add_argument("--max-chars", type=int, dest="max_chars")
    p.add_argument("--languages", dest="ocr_languages")
    p.add_argument("--psm", type=int, dest="ocr_psm", choices=range(14), metavar="0-13")
    p.add_argument("--workers", type=int)
    for flag in ("aggressive", "no-ocr", "force-ocr", "smart-filter"):
        p.add_argument(f"--{flag}", action="store_true", default=None, dest=flag.replace("-", "_"))
    p.add_argument("--keep-empty-pages", action="store_false", default=None, dest="drop_empty_pages")
    p.add_argument("--no-merge", action="store_false", default=None, dest="merge_continuations")
    p.add_argument("--no-cache", action="store_false", default=None, dest="use_cache")
    p.add_argument("--profile", action="store_true", help="show what each step removed")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--log-file")
    p.add_argument("--version", action="version", version=__version__)
    return p


OPTIONS = ("max_chars", "ocr_languages", "ocr_psm", "workers", "aggressive", "no_ocr", "force_ocr", "smart_filter", "drop_empty_pages", "merge_continuations", "use_cache")


def main(argv: list[str] | None = None) -> int:
    """0 if every file came out, 1 if any failed or isn't there, 2 for wrong options."""
    args = parser().parse_args(argv)
    if args.quiet and args.verbose:
        print("--quiet and --verbose exclude each other", file=sys.stderr)
        return 2
    try:
        config = load_config(args.config)
        options = with_overrides(config.options, **{n: getattr(args, n) for n in OPTIONS})
    except ConfigError as e:
        print(e, file=sys.stderr)
        return 2
    from pagewright.operators import render
    from pagewright.plans.process import process_files
    from pagewright.session import local_session

    spark = local_session()
    kind = args.format or config.format
    try:
        done = process_files(spark, args.paths, options, kind, args.recursive, cache_folder=str(home() / "cache" / "ocr") if options.use_cache else None).persist()
    except AnalysisException as e:  # a path that isn't there
        print(str(e).splitlines()[0], file=sys.stderr)
        return 1
    told = events.of_documents(done, len(default_pipeline().steps))
    if log_file := args.log_file or config.log_file:
        events.append_to_file(told, log_file)
    level = "ERROR" if args.quiet else "DEBUG" if args.verbose else config.log_level
    for r in events.key_values(events.at_least(told, level)).toLocalIterator():
        print(r.value, file=sys.stderr)
    good = done.where("error is null")
    if args.out:
        render.write_files(good, args.out, kind)
    else:
        for r in good.orderBy("source", "doc_id").select("output").toLocalIterator():
            print(r.output)
    if not args.quiet:
        report(good)
    if args.profile:
        # The sections as they were cleaned, one by one.
        sections = good.select("doc_id", F.inline("sections")).select("doc_id", "pos", F.col("original").alias("text"))
        metrics = default_pipeline(options.aggressive, options.dedup_min_occurrences).metrics(sections, ["doc_id", "pos"])
        print(table(steps.shares(steps.rollup(metrics)).orderBy("first_step")), file=sys.stderr)
    failed = not done.where("error is not null").isEmpty() or done.isEmpty()
    done.unpersist()
    return int(failed)


def report(good: DataFrame) -> None:
    """What was saved in each document, and the first five of its recognised pages."""
    rows = stats.savings(good.orderBy("source", "doc_id"), ("source", "ocr_pages"))
    pages = F.concat(F.array_join(F.slice(F.col("ocr_pages").cast("array<string>"), 1, 5), ", "), F.when(F.size("ocr_pages") > 5, "…").otherwise(""))
    print(table(rows.select("source", "metric", "before", "after", "gain", pages.alias("recognised"))), file=sys.stderr)


def table(df: DataFrame) -> str:
    """A small table as aligned text."""
    rows = [df.columns, *([str(x) for x in r] for r in df.toLocalIterator())]
    widths = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in rows)


if __name__ == "__main__":
    sys.exit(main())
