"""Command line: tender run, watch and draft; grant run, write and draft."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from tendrel.functions import rules
from tendrel.operators import drafting, verdict
from tendrel.operators.extract import doc_lines, extract
from tendrel.plans import pipeline, render
from tendrel.session import local_session
from tendrel.sources import readers
from tendrel.streaming import watch as watching

USAGE, NOTHING, NO_LIBRARY, NO_DRAFTING = 2, 3, 4, 5


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tendrel")
    product = p.add_subparsers(dest="product")
    for name, (call, library) in {"tender": ("--rfp", "--corpus"), "grant": ("--call", "--library")}.items():
        commands = product.add_parser(name).add_subparsers(dest="command")
        for command in ("run", "watch", "draft") if name == "tender" else ("run", "write", "draft"):
            c = commands.add_parser(command)
            c.add_argument("--inbox" if command == "watch" else call, dest="input", required=True)
            c.add_argument(library, dest="corpus", required=True)
            c.add_argument("--out", default="out")
            if name == "tender":
                c.add_argument("--answered-at", type=float, default=verdict.ANSWERED_AT)
                c.add_argument("--weak-at", type=float, default=verdict.WEAK_AT)
            if command == "watch":
                c.add_argument("--interval", type=float, default=5.0)
            if command == "draft":
                c.add_argument("--batch-size", type=int, default=5)
                c.add_argument("--effort", choices=drafting.EFFORTS, default="high")
                c.add_argument("--dry-run", action="store_true")
    return p


def main(argv: list[str] | None = None, client: drafting.DraftClient | None = None) -> int:
    for stream in (sys.stdout, sys.stderr):
        if hasattr(stream, "reconfigure"):
            stream.reconfigure(encoding="utf-8", errors="replace")
    p = parser()
    argv = list(sys.argv[1:] if argv is None else argv)
    # flags without a command belong to run
    if argv[:1] in (["tender"], ["grant"]) and argv[1:] and argv[1].startswith("-") and argv[1] not in ("-h", "--help"):
        argv.insert(1, "run")
    try:
        args = p.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    if not getattr(args, "command", None):
        p.print_help()
        return USAGE
    try:
        if args.product == "tender":
            verdict.check_thresholds(args.answered_at, args.weak_at)
        if getattr(args, "batch_size", 1) < 1:
            raise ValueError("--batch-size must be at least 1")
        if Path(args.out).is_file():
            raise ValueError(f"--out {args.out} is a file")
        if not Path(args.corpus).is_dir():
            raise ValueError(f"{args.corpus} is not a folder")
    except ValueError as e:
        print(e, file=sys.stderr)
        return USAGE
    spark = local_session(app="tendrel-cli")
    if args.command == "watch":
        try:
            watching.run(spark, args.inbox if hasattr(args, "inbox") else args.input, args.corpus, args.out, Path(args.out) / ".checkpoint", args.interval, answered_at=args.answered_at, weak_at=args.weak_at)
        except watching.EmptyLibrary as e:
            print(f"{e}: no readable section", file=sys.stderr)
            return NO_LIBRARY
        return 0
    path = Path(args.input)
    try:
        text = readers.read_bytes(path.name, path.read_bytes())
    except (readers.Unreadable, OSError) as e:
        print(e, file=sys.stderr)
        return USAGE
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    if extract(doc_lines(docs), rules.TENDER if args.product == "tender" else rules.GRANT).isEmpty():
        print(f"{path.name}: nothing asked for", file=sys.stderr)
        return NOTHING
    chunks, skipped = readers.load_corpus(spark, args.corpus)
    for row in skipped.collect():  # before any result: missing evidence explains gaps
        print(f"skipped {row['name']}: {row['reason']}", file=sys.stderr)
    chunks = chunks.cache()
    if chunks.isEmpty():
        print(f"{args.corpus}: no readable section", file=sys.stderr)
        return NO_LIBRARY
    return (_tender if args.product == "tender" else _grant)(args, path, docs, chunks, client)


def _tender(args, path: Path, docs, chunks, client) -> int:
    assessed = pipeline.tender_coverage(docs, chunks, args.answered_at, args.weak_at).cache()
    rows = verdict.action_order(assessed).collect()
    render.write(args.out, {"coverage.csv": render.coverage_csv(rows), "coverage.md": render.coverage_markdown(path.stem, rows), "coverage.html": render.coverage_html(path.stem, rows)})
    print(render.console(rows))
    if args.command == "run":
        return 0
    prompts = pipeline.tender_prompts(assessed, chunks, args.batch_size)
    return _draft(args, prompts, client, drafting.TENDER_RESPONSE, drafting.draftable(assessed), lambda drafts: {"drafts.md": render.drafts_markdown(drafts, rows)})


def _grant(args, path: Path, docs, chunks, client) -> int:
    scored = pipeline.grant_scores(docs, chunks).cache()
    rows = scored.orderBy("line_no").collect()
    render.write(args.out, {"analysis.md": render.analysis_markdown(path.stem, rows)})
    known = sum(r["source_tag"] == "EVIDENCED" for r in rows)
    print(f"{len(rows)} questions: {known} with evidence, {len(rows) - known} without")
    if args.command == "run":
        return 0
    if args.command == "write":
        drafts = drafting.local_drafts(pipeline.with_extracts(scored, chunks)).orderBy("line_no").collect()
        render.write(args.out, _application(path.stem, drafts))
        return 0
    prompts = pipeline.grant_prompts(scored, chunks, args.batch_size)

    def files(drafts: list) -> dict[str, str]:
        by = {d["requirement_id"]: d for d in drafts}
        merged = [r.asDict() | {k: by[r["id"]][k] for k in ("answer", "placeholders", "note")} for r in rows if r["id"] in by]
        return _application(path.stem, merged)

    return _draft(args, prompts, client, drafting.GRANT_RESPONSE, scored, files)


def _application(name: str, rows: list) -> dict[str, str]:
    return {"application.md": render.application_markdown(name, rows), "application.html": render.application_html(name, rows), "sections.csv": render.sections_csv(rows)}


def _draft(args, prompts, client, schema: str, asked, files) -> int:
    if args.dry_run:
        for row in prompts.orderBy("batch").collect():
            print(f"--- batch {row['batch']} ({row['kind']}): {', '.join(row['ids'])}\n{row['prompt']}\n")
        return 0
    try:
        answers = drafting.generate(prompts, client, effort=args.effort)
    except drafting.DraftingUnavailable as e:
        print(e, file=sys.stderr)
        return NO_DRAFTING
    responses = asked.sparkSession.createDataFrame(answers, "batch int, response string").select("response")
    drafts = drafting.read_responses(asked.select("id"), responses, schema=schema).orderBy("requirement_id").collect()
    render.write(args.out, files(drafts))
    return 0


def tender() -> int:
    """Console script of the tender product."""
    return main(["tender", *sys.argv[1:]])


def grant() -> int:
    """Console script of the grant product."""
    return main(["grant", *sys.argv[1:]])


if __name__ == "__main__":
    sys.exit(main())
