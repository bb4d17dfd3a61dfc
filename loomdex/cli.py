"""Command line: index, status, ask, purge. ``python -m loomdex.cli --index FOLDER COMMAND``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from loomdex.config import Settings
from loomdex.operators.chunking import split_documents
from loomdex.operators.evaluation import quality
from loomdex.plans.evaluate import evaluate
from loomdex.plans.index import Index, run
from loomdex.plans.retrieve import Corpus, ask, retrieve
from loomdex.session import local_session, ship
from loomdex.sources import files as source
from loomdex.sources.records import export_chunks, read_cases, write_report


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomdex")
    p.add_argument("--index", default="loomdex-index", help="folder of the tables")
    sub = p.add_subparsers(dest="command")
    i = sub.add_parser("index", help="index what is new or changed")
    i.add_argument("roots", nargs="+")
    i.add_argument("--limit", type=int)
    i.add_argument("--update", action="store_true", help="index unchanged files again")
    i.add_argument("--rebuild", action="store_true", help="empty the tables first")
    i.add_argument("--yes", action="store_true", help="rebuild without asking")
    i.add_argument("--verbose", action="store_true", help="tell each step, and the first 20 errors")
    a = sub.add_parser("ask", help="answer questions")
    a.add_argument("questions", nargs="+")
    a.add_argument("--top-n", type=int, default=4)
    a.add_argument("--threshold", type=float, default=0.35)
    a.add_argument("--debug", action="store_true", help="show the hits with their scores, and the context")
    sub.add_parser("status", help="counts of the tables")
    v = sub.add_parser("preview", help="segments and chunks of files, without indexing them")
    v.add_argument("roots", nargs="+")
    v.add_argument("-n", type=int, default=10)
    v.add_argument("--chars", type=int, default=200)
    v.add_argument("--segments", action="store_true", help="show the segments too")
    v.add_argument("--json", help="folder for the chunks of each document as JSON")
    e = sub.add_parser("eval", help="hit rates of evaluation cases")
    e.add_argument("cases", help="JSON file with an array cases")
    e.add_argument("--mode", choices=("baseline", "optimized", "both"), default="both")
    for layer in ("rewrite", "hyde", "mmr"):
        e.add_argument(f"--off-{layer}", action="store_true")
    e.add_argument("--limit", type=int, help="the first cases by id")
    e.add_argument("--only", help="cases of one category")
    e.add_argument("--threshold", type=float, default=0.35)
    e.add_argument("--out", help="folder for the report as JSON")
    sub.add_parser("quality", help="checks of the indexed chunks; exit code 1 where one fails")
    c = sub.add_parser("chat", help="questions one by one; :quit, :status, :threshold X, :topn N")
    c.add_argument("--top-n", type=int, default=4)
    c.add_argument("--threshold", type=float, default=0.35)
    g = sub.add_parser("purge", help="empty the tables")
    g.add_argument("--yes", action="store_true")
    args = p.parse_args(argv)
    if not args.command:
        p.print_help()
        return 1
    spark = local_session()
    ship(spark)
    index = Index(spark, args.index)
    if args.command == "index":
        if args.rebuild:
            if not args.yes and input("Empty all tables first? [y/N] ").strip().lower() != "y":
                return 1
            purge(index)
        print(run(index, args.roots, force=args.update, limit=args.limit, tell=print if args.verbose else None))
        if args.verbose:
            for r in index.manifest.read().where("status = 'error'").orderBy("file_path").limit(20).collect():
                print(f"  {r['file_path']}: {r['error_msg']}")
    elif args.command == "ask":
        answer(index, args.questions, args.threshold, args.top_n, args.debug)
    elif args.command == "eval":
        cases = read_cases(spark, args.cases)
        cases = cases.where(F.col("category") == args.only) if args.only else cases
        cases = cases.orderBy("id").limit(args.limit) if args.limit is not None else cases
        chosen = Settings(dense_min=args.threshold, rewrite=not args.off_rewrite, hyde=not args.off_hyde, mmr=not args.off_mmr)
        rates = evaluate(cases, corpus(index), {} if args.mode == "baseline" else {"optimized": chosen}, with_baseline=args.mode != "optimized", base=chosen)
        rates.orderBy("tag", "level", "category", "difficulty").show(200, False)
        if args.out:
            write_report(rates, args.out)
    elif args.command == "chat":
        threshold, top_n = args.threshold, args.top_n
        for line in iter(lambda: input("> ").strip(), ":quit"):
            word, _, value = line.partition(" ")
            if word in (":exit", ":q"):
                break
            if word == ":status":
                status(index)
            elif word == ":threshold":
                threshold = float(value)
            elif word == ":topn":
                top_n = int(value)
            elif line:
                answer(index, [line], threshold, top_n)
    elif args.command == "preview":
        parsed = source.parse(source.scan(spark, args.roots))
        parsed.groupBy("doc", "kind", "error").count().orderBy("doc").show(args.n, args.chars)
        if args.segments:
            parsed.where("error is null").select("doc", "seg_no", "page", "kind", "level", "heading", "text").show(args.n, args.chars)
        chunks = split_documents(parsed.where("error is null").drop("error"))
        if args.json:
            export_chunks(chunks, args.json)
        chunks.select("file_name", "chunk_index", "chunk_type", "token_estimate", "content").show(args.n, args.chars)
    elif args.command == "quality":
        found = quality(index.chunks.read()).collect()
        for r in found:
            print(f"{r['severity']:4} {r['check']:20} {r['n']}")
        return int(any(r["severity"] == "fail" and r["n"] for r in found))
    elif args.command == "status":
        status(index)
    elif args.command == "purge":
        if not args.yes and input("Empty all tables? [y/N] ").strip().lower() != "y":
            return 1
        purge(index)
    return 0


def corpus(index: Index) -> Corpus:
    return Corpus(index.chunks.read().where("not is_parent"), index.vectors.read(), stored=(index.postings.read(), index.lengths.read()))


def answer(index: Index, questions: list[str], threshold: float, top_n: int, debug: bool = False) -> None:
    asked = index.spark.createDataFrame([(str(n), q) for n, q in enumerate(questions)], "query_id string, text string")
    settings = Settings(dense_min=threshold, final_top_n=top_n)
    if debug:
        hits, verdicts = retrieve(asked, corpus(index), settings)
        verdicts.show(truncate=False)
        hits.select("query_id", "rank", "matched_by", "rrf", "dense_score", "sparse_score", "file_name", "page").orderBy("query_id", "rank").show(100, False)
    for r in ask(asked, corpus(index), settings).orderBy("query_id").collect():
        print(f"[{r['state']}] {r['text']}")
        for c in r["citations"] or []:
            print(f"  [{c['rank']}] {c['file_name']} {c['uri']}")
        if debug:
            print(r["context"])


def status(index: Index) -> None:
    m = index.manifest.read().groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()
    print({"files": {r["status"]: r["n"] for r in m}, "chunks": index.chunks.read().where("not is_parent").count(), "vectors": index.vectors.read().count()})


def purge(index: Index) -> None:
    for t in (index.chunks, index.vectors, index.postings, index.lengths, index.manifest, index.events):
        t.truncate()


if __name__ == "__main__":
    sys.exit(main())
