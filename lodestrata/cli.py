"""Command line: ingest, query, demo, gdrive, stats, serve, watch."""

from __future__ import annotations

import argparse
import json
import sys

from .config import load
from .plans import engine
from .session import local_session
from .streaming import watch as W

# The demonstration queries and their filters.
DEMO = (
    ("Show me everything on Quantum", None),
    ("What meetings on semiconductor manufacturing?", None),
    ("Letters to the President in 2025", {"date": ["2025-01-01", "2025-12-31"]}),
    ("War room announcements about water supply", None),
    ("Cabinet decisions on SAMAGRA", None),
)
JSON_KEYS = ("title", "provenance", "category", "date", "language", "score", "why", "snippet")


def parse_filters(items: list[str] | None) -> dict:
    """key=value; ``date=a..b`` is a range; items without = are ignored."""
    out: dict = {}
    for item in items or ():
        key, eq, value = item.partition("=")
        if eq:
            low, dots, high = value.partition("..")
            out[key.strip()] = [low.strip(), high.strip()] if key.strip() == "date" and dots else value.strip()
    return out


def show(result: engine.SearchResult) -> None:
    if result.answer:
        print(f"\n>> {result.answer}")
    if not result.hits:
        print("\n(nothing found)\n")
    for h in result.hits:
        about = " · ".join(str(x) for x in (h["category"], h["source_type"], h["language"], h["date"], h["department"]) if x)
        print(f"\n{h['rank']}. {h['title']}\n   {about}\n   from {h['provenance']}\n   {h['snippet']}\n   found by {h['why']}, {h['score']:.4f}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestrata", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name: sub.add_parser(name)
    c = add("ingest")
    c.add_argument("path", nargs="?")
    c.add_argument("--append", action="store_true")
    c.add_argument("--embedder")
    c = add("query")
    c.add_argument("query")
    c.add_argument("-n", "--limit", type=int, default=10)
    c.add_argument("-f", "--filter", action="append")
    c.add_argument("--answer", action=argparse.BooleanOptionalAction, default=None)
    c.add_argument("--json", action="store_true")
    c.add_argument("--embedder")
    c = add("demo")
    c.add_argument("-n", "--limit", type=int, default=5)
    c.add_argument("--answer", action="store_true")
    c = add("gdrive")
    c.add_argument("folder_id")
    c.add_argument("-c", "--credentials")
    c.add_argument("--no-recursive", action="store_true")
    c.add_argument("--append", action="store_true")
    c.add_argument("--watch", action="store_true")
    c.add_argument("--interval", type=float, default=300.0)
    c.add_argument("--embedder")
    add("stats")
    c = add("serve")
    c.add_argument("--watch", action="store_true")
    c.add_argument("--interval", type=float, default=2.0)
    c = add("watch")
    c.add_argument("--interval", type=float, default=2.0)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args, cfg = parser().parse_args(argv), load()
    spark = spark or local_session()
    embedder = getattr(args, "embedder", None) or cfg.embedder
    build = lambda path=None, reset=True: engine.build_index(spark, cfg.index, path or cfg.data_dir, embedder, reset)
    refresh = lambda: engine.refresh_index(spark, cfg.index, cfg.data_dir, embedder)
    find = lambda q, **k: engine.search(spark, cfg.index, q, embedder=embedder, **k)
    if args.command == "ingest":
        _print_summary(build(args.path, not args.append))
    elif args.command == "query":
        result = find(args.query, limit=args.limit, filters=parse_filters(args.filter), answer=cfg.answer if args.answer is None else args.answer)
        if args.json:
            hits = [{k: h[k] for k in JSON_KEYS} for h in result.hits]
            print(json.dumps({"query": result.query, "answer": result.answer, "hits": hits}, ensure_ascii=False, indent=2))
        else:
            show(result)
    elif args.command == "demo":
        if not engine.open_index(spark, cfg.index).exists():
            print(f"There is no index at {cfg.index} yet: reading {cfg.data_dir}")
            build()
        for q, filters in DEMO:
            print(f"\n{'=' * 72}\nQ: {q}" + (f"   filter={filters}" if filters else ""))
            show(find(q, limit=args.limit, filters=filters, answer=args.answer or cfg.answer))
    elif args.command == "gdrive":
        from .sources.drive import connection

        connect = connection(args.credentials)
        pull = lambda reset=not args.append: engine.build_index_drive(spark, cfg.index, connect, args.folder_id, embedder, not args.no_recursive, reset)
        _print_summary(pull())
        if args.watch:
            W.watch_drive(lambda: pull(True), args.interval)
    elif args.command == "stats":
        index = engine.open_index(spark, cfg.index)
        _print_summary(engine._summary(index, index.meta()))
    elif args.command == "serve":
        from .web import serve

        if args.watch:
            W.start_background(refresh, args.interval)
            cfg.watching = True
        elif not engine.open_index(spark, cfg.index).exists():
            build()
        serve(spark, cfg)
    else:
        W.watch(refresh, args.interval)
    return 0


def _print_summary(figures: dict) -> None:
    print("{db}: {indexed} rows read".format(**figures))
    print("\n".join(f"  {key} = {value}" for key, value in figures.items() if key not in ("indexed", "db")))


if __name__ == "__main__":
    sys.exit(main())
