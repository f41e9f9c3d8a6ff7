"""Command line: ``python -m lexloom info|index|search|ask``. Exit codes: 0 done, 1 error, 2 wrong use."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from .errors import LexloomError
from .plans.engine import Engine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexloom")
    p.add_argument("--storage", default=".lexloom")
    p.add_argument("--collection", default="default")
    p.add_argument("--provider", choices=["hashing", "local"])
    p.add_argument("--model")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("info", help="what the collection holds")
    index = sub.add_parser("index", help="add files, directories or texts")
    index.add_argument("paths", nargs="*")
    index.add_argument("--text", action="append", default=[])
    for name in ("search", "ask"):
        one = sub.add_parser(name)
        one.add_argument("query")
        one.add_argument("--top-k", type=int)
        one.add_argument("--mode", choices=["auto", "hybrid", "keyword", "semantic"])
        one.add_argument("--json", action="store_true")
    return p


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.command == "index" and not (args.paths or args.text):
        print("error: give a path or --text", file=sys.stderr)
        return 2
    given = {"embedding_provider": args.provider, "embedding_model": args.model}
    db = Engine(spark, storage_path=args.storage, collection=args.collection, **{k: v for k, v in given.items() if v})
    if args.command == "info":
        print(db.to_json())
    elif args.command == "index":
        n = sum((db.add_directory if os.path.isdir(p) else db.add_file)(p) for p in args.paths) + sum(db.add(t) for t in args.text)
        print(f"{n} chunks added to {args.collection!r}, which has {db.count()}.")
    elif args.command == "search":
        rows = [r.asDict(True) for r in db.search(args.query, top_k=args.top_k, mode=args.mode).select("score", "text", "document_id", "chunk_id", "language", "source", "page", "metadata").collect()]
        print(json.dumps(rows, ensure_ascii=False, indent=2) if args.json else "\n".join(f"{r['score']:.4f}  {r['text']}" for r in rows) or "No results.")
    else:
        got = db.ask(args.query, top_k=args.top_k, mode=args.mode)
        print(got["answer"])
        for i, c in enumerate(got["citations"], 1):
            page = f", page {c['page']}" if c["page"] is not None else ""
            print(f"  [{i}] ({c['source'] or 'unknown'}{page}) {c['text'] if len(c['text']) <= 80 else c['text'][:77] + '...'}")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lexloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        return run(args, spark)
    except (LexloomError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
