"""Command line: ``ask`` a question of ranked hits, or ``run`` a registered query over a folder of tables.

Exit codes: 0 answered or done, 2 unusable input, 3 refused, 4 a quota or an unavailable provider, 5 an unusable reply.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys

DONE, UNUSABLE, REFUSED, PROVIDER, REPLY = 0, 2, 3, 4, 5


def rendered(result: dict, hits: list[dict]) -> str:
    """An answer as text: the answer, what it cites, and what was missing."""
    lines = [result["answer"], ""]
    lines += [f"[{n}] {hits[n - 1].get('title') or hits[n - 1]['text'][:80]}" for n in result["citations"]]
    if result["insufficient"]:
        lines.append(f"(refused: {result['insufficient_reason']})")
    if result["missing_information"]:
        lines.append(f"missing: {result['missing_information']}")
    return "\n".join(lines).rstrip()


def ask(args: argparse.Namespace) -> int:
    from .plans.answering import AnswerError, answer
    from .sources.models import Caller, ModelError, QuotaError, UnavailableError

    try:
        with open(args.hits, encoding="utf-8") as f:
            hits = json.load(f)
        module, _, name = args.model.partition(":")
        caller = Caller(getattr(importlib.import_module(module), name))
        if not all(isinstance(h, dict) and {"score", "text"} <= h.keys() for h in hits):
            raise ValueError("hits: a list of objects with score and text is expected")
    except (OSError, ValueError, ImportError, AttributeError) as e:
        print(f"unusable input: {e}", file=sys.stderr)
        return UNUSABLE
    try:
        result = answer(args.question, hits, args.threshold, caller)
    except (QuotaError, UnavailableError) as e:
        print(f"the model can't be reached now: {e}", file=sys.stderr)
        return PROVIDER
    except (ModelError, AnswerError) as e:
        print(f"unusable reply: {e}", file=sys.stderr)
        return REPLY
    print(json.dumps(result, ensure_ascii=False) if args.json else rendered(result, hits))
    return REFUSED if result["insufficient"] else DONE


def run(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from .catalogue import QUERIES

    if args.query not in QUERIES:
        print(f"no such query: {args.query}; there are {', '.join(sorted(QUERIES))}", file=sys.stderr)
        return UNUSABLE
    found = QUERIES[args.query](SparkSession.builder.getOrCreate(), args.folder)
    found.write.parquet(args.out) if args.out else found.show(20, truncate=80)
    return DONE


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpusloom", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("ask")
    one.add_argument("question")
    one.add_argument("--hits", required=True, help="JSON list of ranked passages with score and text")
    one.add_argument("--model", required=True, help="module:function from a prompt to a Reply")
    one.add_argument("--threshold", type=float, default=0.0)
    one.add_argument("--json", action="store_true")
    two = commands.add_parser("run")
    two.add_argument("query")
    two.add_argument("folder")
    two.add_argument("--out")
    args = parser.parse_args(argv)
    return {"ask": ask, "run": run}[args.command](args)


if __name__ == "__main__":
    sys.exit(main())
