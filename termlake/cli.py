"""Command line: ``python -m termlake.cli -c corpus.jsonl -q "a query"``; without a query, a prompt."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession

import termlake
from termlake.engine import Engine
from termlake.params import checked_k
from termlake.sources import corpus

HELP = """:top N (k)       results to show
:explain ID (e)  what the last query's terms add to a document's score
:stats (s)       size of the index
:clear (c)       clear the screen
:help (h, ?)     this text
:quit (q, exit)  leave"""


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="termlake", description="Ranked search over a corpus.")
    parser.add_argument("-q", "--query", help="answer one query and end")
    parser.add_argument("-d", "--dataset", help="folder of an unpacked retrieval test set")
    parser.add_argument("-c", "--corpus", help="JSON lines of id, title, content and metadata; goes before --dataset")
    parser.add_argument("-k", "--top-k", type=int, default=10)
    parser.add_argument("--stats", action="store_true", help="show the size of the index and end")
    parser.add_argument("--version", action="version", version=f"%(prog)s {termlake.__version__}")
    return parser.parse_args(args)


class Prompt:
    """Commands and queries, one line each."""

    def __init__(self, engine: Engine, k: int, out=print):
        self.engine, self.k, self.out, self.last = engine, checked_k(k), out, None

    def stats(self) -> None:
        row = self.engine.stats().first()
        self.out(f"documents {row.num_docs}, terms {row.num_terms}, average length {row.avgdl:.1f}, k {self.k}")

    def search(self, query: str) -> None:
        self.last = query
        rows = self.engine.snippets(query, self.k, mark="*").orderBy("rank").collect()
        for r in rows:
            self.out(f"{r['rank']}. {r.title or '(no title)'} [{r.doc_id}] {r.score:.4f}\n   {r.snippet}")
        if not rows:
            self.out("no results")

    def explain(self, doc_id: str) -> None:
        if self.last is None:
            self.out("search first")
            return
        kind = self.engine.index.doc_stats.schema["doc_id"].dataType.typeName()
        for r in self.engine.explain(self.last, [int(doc_id) if kind in ("long", "integer") else doc_id]).orderBy("term").collect():
            self.out(f"{r.term}: {r.term_score:.4f}")

    def line(self, text: str) -> bool:
        """False at the end."""
        text = text.strip()
        if not text.startswith(":"):
            if text:
                self.search(text)
            return True
        command, _, rest = text[1:].partition(" ")
        command, rest = command.lower(), rest.strip()
        if command in ("quit", "q", "exit"):
            return False
        if command in ("help", "h", "?"):
            self.out(HELP)
        elif command in ("stats", "s"):
            self.stats()
        elif command in ("clear", "c"):
            self.out("\033[2J\033[H")
        elif command in ("top", "k"):
            try:
                self.k = checked_k(int(rest))
            except ValueError:
                self.out("top needs a whole number of at least 1")
        elif command in ("explain", "e"):
            self.explain(rest) if rest else self.out("explain needs the id of a document")
        else:
            self.out(f"unknown command {command}; :help lists them")
        return True


def main(args: list[str] | None = None) -> int:
    """0 when done, 1 after an error, 130 when interrupted."""
    options = arguments(args)
    logging.basicConfig(level=os.environ.get("TERMLAKE_LOG_LEVEL", "WARNING"), format=os.environ.get("TERMLAKE_LOG_FORMAT", logging.BASIC_FORMAT), stream=sys.stderr)
    try:
        checked_k(options.top_k)
        spark = SparkSession.builder.appName("termlake").getOrCreate()
        if options.corpus:
            docs = corpus.read_jsonl(spark, options.corpus)
        elif options.dataset:
            docs = corpus.read_retrieval_set(spark, options.dataset)[0]
        else:
            docs = corpus.sample_corpus(spark)
        prompt = Prompt(Engine(docs), options.top_k)
        if options.stats:
            prompt.stats()
        elif options.query is not None:
            prompt.search(options.query)
        else:
            while True:
                try:
                    text = input("> ")
                except EOFError:
                    break
                if not prompt.line(text):
                    break
        return 0
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001 - an error is told, not raised, at the command line
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
