"""Command line: python -m corpuscle normalize | match | serve | status | doctor | targets | preprocess | compile | version."""

from __future__ import annotations

import argparse
import codecs
import json
import os
import sys
from collections.abc import Iterator

from corpuscle import __version__


def _session():
    from pyspark.sql import SparkSession

    from corpuscle.session import local_session

    return SparkSession.getActiveSession() or local_session()


#: Bytes read from standard input at once.
PIECE = 64 << 10


def pieces(args: argparse.Namespace) -> Iterator[str]:
    """The text in pieces: the argument as it is, else standard input, of which a character cut at the end of a piece goes with the next. Bytes that are no UTF-8 are a ``ValueError``."""
    if args.text is not None:
        yield args.text
        return
    decoder = codecs.getincrementaldecoder("utf-8")()
    while data := sys.stdin.buffer.read(PIECE):
        yield decoder.decode(data)
    yield decoder.decode(b"", True)


def normalize(args: argparse.Namespace) -> int:
    from corpuscle.functions.normalize import Normalizer

    normalizer = Normalizer()
    for piece in pieces(args):
        sys.stdout.write("".join(c for c, _, _ in normalizer.feed(piece)))
    print()
    return 0


def match(args: argparse.Namespace) -> int:
    """Matches of one text as JSON lines, as soon as they are found, then a line that it is done; with a dictionary too large for this process once all is read."""
    from corpuscle import pipeline
    from corpuscle.operators import matching
    from corpuscle.streaming import sessions

    spark = _session()
    known = pipeline.open_runtime(spark, args.data_dir)
    if known.limit(matching.BROADCAST_KEYS + 1).count() > matching.BROADCAST_KEYS:
        docs = spark.createDataFrame([(0, "".join(pieces(args)))], "doc_id long, text string")
        found = pipeline.match_texts(docs, known, include_disambiguation=not args.exclude_disambiguation, most=args.max_candidates_per_surface)
        for row in matching.events(docs, found).orderBy("seq").toLocalIterator():
            print(row.line)
        return 0
    lookup = sessions.lookup(known)
    session = sessions.Session({"include_disambiguation": not args.exclude_disambiguation, "max_candidates_per_surface": args.max_candidates_per_surface})
    for piece in pieces(args):
        for event in session.chunk(piece, lookup):
            if event["type"] == "match":
                print(json.dumps(event, ensure_ascii=False, separators=(",", ":")))
    print(json.dumps({"type": "done", "stats": {"matches": session.matches}}, separators=(",", ":")))
    return 0


def status(args: argparse.Namespace) -> int:
    from corpuscle import pipeline
    from corpuscle.sources import tables

    spark = _session()
    pipeline.open_runtime(spark, args.data_dir)
    print(json.dumps(tables.read_manifest(spark, f"{args.data_dir}/dictionary").first().asDict(True), ensure_ascii=False))
    return 0


def doctor(args: argparse.Namespace) -> int:
    """What is wrong with a published dictionary; 1 if anything is."""
    from pyspark.sql import functions as F

    from corpuscle import pipeline
    from corpuscle.functions.text import qid_text
    from corpuscle.operators import checks

    spark = _session()
    known = pipeline.open_runtime(spark, args.data_dir)
    rows = known.select("surface_id", "surface_key", F.array_join(F.transform("qids", lambda q: qid_text(q)), "|").alias("qids"), F.col("qid_count"))
    problems = checks.violations(rows).limit(100).collect()
    for p in problems:
        print(f"{p.surface_id}\t{p.problem}")
    print("ok" if not problems else "problems found")
    return int(bool(problems))


def targets(args: argparse.Namespace) -> int:
    from corpuscle import pipeline

    for r in pipeline.targets(_session(), args.out, args.wikis, args.components, args.date).collect():
        print(f"{r.url} -> {r.path}")
    return 0


def preprocess(args: argparse.Namespace) -> int:
    from corpuscle import pipeline

    pipeline.preprocess(_session(), args.dumps, args.out, args.wikis, args.date, args.limit)
    return 0


def compile_(args: argparse.Namespace) -> int:
    from corpuscle import pipeline

    pipeline.compile_dictionary(_session(), args.preprocess, args.out, args.shard_size)
    return 0


def serve(args: argparse.Namespace) -> int:
    """Answer over HTTP and WebSocket until interrupted."""
    from corpuscle import pipeline
    from corpuscle.streaming.service import Service

    host, _, port = args.bind.rpartition(":")
    service = Service(pipeline.open_runtime(_session(), args.data_dir), (host, int(port)))
    print(f"listening on http://{host}:{service.server_address[1]}", file=sys.stderr)
    try:
        service.serve_forever()
    except KeyboardInterrupt:
        service.stopping.set()
        service.server_close()
    return 0


def version(args: argparse.Namespace) -> int:
    print(__version__)
    return 0


def _list(text: str) -> list[str]:
    return [p.strip() for p in text.split(",") if p.strip()]


def parser() -> argparse.ArgumentParser:
    from corpuscle.functions.text import COMPONENTS

    top = argparse.ArgumentParser(prog="corpuscle", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(name: str, run, *options: tuple[str, dict]) -> None:
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        for option, how in options:
            sub.add_argument(option, **how)

    data, text = ("--data-dir", {"default": None}), ("--text", {"default": None})
    wikis, date = ("--wikis", {"type": _list, "default": ["zhwiki", "enwiki"]}), ("--date", {"default": "latest"})
    command("normalize", normalize, text)
    command("match", match, text, data, ("--exclude-disambiguation", {"action": "store_true"}), ("--max-candidates-per-surface", {"type": int}))
    command("serve", serve, data, ("--bind", {"default": os.environ.get("CORPUSCLE_BIND", "127.0.0.1:8719")}))
    command("status", status, data)
    command("doctor", doctor, data)
    command("targets", targets, ("--out", {"default": "data/dumps"}), wikis, ("--components", {"type": _list, "default": list(COMPONENTS)}), date)
    command("preprocess", preprocess, ("--dumps", {"required": True}), ("--out", {"required": True}), wikis, date, ("--limit", {"type": int}))
    command("compile", compile_, ("--preprocess", {"required": True}), ("--out", {"required": True}), ("--shard-size", {"type": int, "default": 250_000}))
    command("version", version)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if hasattr(args, "data_dir"):
        args.data_dir = args.data_dir or os.environ.get("CORPUSCLE_DATA_DIR")
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
