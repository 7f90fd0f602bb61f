"""python -m quire list
python -m quire run QUERY FOLDER [--out PATH]
python -m quire verify FOLDER
python -m quire plan FOLDER --out PATH [--least TOKENS] [--most TOKENS]
python -m quire export | index FOLDER --out PATH"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from quire.operators import figures, files, notes
from quire.operators import plan as planner
from quire.plans import catalogue, library
from quire.session import cut, session, table
from quire.sources import sinks


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quire", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="run one query")
    run.add_argument("query", choices=sorted(catalogue.QUERIES))
    run.add_argument("folder")
    run.add_argument("--out", help="write Parquet there instead of showing rows")
    check = commands.add_parser("verify", help="what notes lost; 1 if any note has a problem")
    check.add_argument("folder")
    for name, what in (("plan", "chunks of all books, and their texts, as Parquet"), ("export", "a file of source text for every chunk"), ("index", "chapter maps and glossaries")):
        stage = commands.add_parser(name, help=what)
        stage.add_argument("folder")
        stage.add_argument("--out", required=True)
        if name == "plan":
            stage.add_argument("--most", type=int, default=6000)
            stage.add_argument("--least", type=int, default=3000)
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    spark = session()
    if args.command == "run":
        df = catalogue.QUERIES[args.query](spark, args.folder)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(40, truncate=100)
        return 0
    if args.command == "verify":
        summary = catalogue.QUERIES["q_verify_summary"](spark, args.folder)
        summary.show(200, truncate=False)
        return int(not summary.where("flagged > 0").isEmpty())
    if args.command == "plan":
        parts = library.plan_parts(spark, args.folder)
        chunks = cut(planner.plan(parts, args.most, args.least))
        sinks.write_tables(chunks.drop("pages").join(planner.chunk_texts(chunks, parts), ["book", "ord"], "left"), args.out, "book")
        return 0
    chunks, books = table(spark, args.folder, "chunks"), table(spark, args.folder, "books")
    if args.command == "export":
        made = files.export_files(chunks, figures.distinct_figures(table(spark, args.folder, "figures")), books).select("path", "text")
    else:
        of = chunks.select(F.col("chunk_id").alias("id"), "book", notes.note_stem(F.col("section"), F.coalesce("title", F.lit(""))).alias("stem"))
        entries = notes.glossary_entries(chunks.where("text IS NOT NULL"), "chunk_id", "text").join(of, "id").withColumn("id", F.col("stem"))
        maps = files.chapter_maps(chunks, books)
        if not (clash := maps.where("clash").limit(1)).isEmpty():
            print(f"{clash.first().path}: the chapter map would replace a note", file=sys.stderr)
            return 1
        place = lambda df: df.select(F.concat(F.lit("notes/"), "book", F.lit("/"), "path").alias("path"), "text")
        made = place(maps).unionByName(place(files.glossary_files(entries, books)))
    outcome = cut(sinks.write_files(made, sinks.claim(args.out)))
    outcome.groupBy("outcome").count().show()
    return int(not outcome.where("outcome <> 'written'").isEmpty())


if __name__ == "__main__":
    sys.exit(main())
