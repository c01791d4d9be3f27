"""Command line: index, ask, watch and list; options may stand before or after the positional argument."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from florilege.api import Engine
from florilege.plans.export import answer_json, answer_text
from florilege.sources.pdf import Tesseract


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="florilege", description="Chat with the files of a folder.")
    top.add_argument("--base", default=os.environ.get("FLORILEGE_HOME") or os.path.expanduser("~/.florilege/collections"))
    top.add_argument("--ocr", action="store_true", help="read images and scanned PDFs with the program tesseract")
    commands = top.add_subparsers(dest="command", required=True)
    for name, what in (("index", "folder"), ("ask", "question"), ("watch", "folder")):
        c = commands.add_parser(name)
        c.add_argument(what)
        c.add_argument("--collection", required=True)
        if name == "ask":
            c.add_argument("--topk", type=int, default=5)
            c.add_argument("--export", help="write the exchange as Markdown to this path")
            c.add_argument("--json", action="store_true", help="print the answer as JSON; nothing is exported then")
        if name == "watch":
            c.add_argument("--interval", type=float, default=5.0, help="seconds")
    commands.add_parser("list")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.ocr and not Tesseract.available():
        print("--ocr needs the program tesseract", file=sys.stderr)
        return 1
    engine = Engine(spark or SparkSession.builder.appName("florilege").getOrCreate(), args.base, ocr=Tesseract() if args.ocr else None)
    if args.command == "index":
        result = engine.index(args.folder, args.collection)
        print(f'Indexed "{args.collection}" from {args.folder}')
        print("  " + "  ".join(f"{k}: {v}" for k, v in result.counts().items()))
        for row in result.report.where("error is not null").orderBy("path").toLocalIterator():
            print(f"  ! {row.path}: {row.error}")
        print(f"  total chunks in collection: {result.collection.chunks.count()}")
    elif args.command == "ask":
        try:
            found = engine.ask(args.question, args.collection, args.topk).persist()
        except FileNotFoundError:
            print(f'no such collection "{args.collection}": index a folder first', file=sys.stderr)
            return 1
        if error := found.first().error:
            print(f"the generator failed: {error}", file=sys.stderr)
            return 1
        if args.json:
            print(answer_json(found).first().json)
            return 0
        print(answer_text(found).first().rendered, end="")
        if args.export:
            with open(args.export, "w", encoding="utf-8") as f:
                f.write(engine.export_session(found, args.collection))
            print(f"\nExported to {args.export}")
    elif args.command == "watch":
        engine.watch(args.folder, args.collection, args.interval).awaitTermination()
    else:
        rows = engine.list_collections().orderBy("name").collect()
        print("\n".join(r.line for r in rows) if rows else "No collections yet.")
    return 0


if __name__ == "__main__":
    sys.exit(main())
