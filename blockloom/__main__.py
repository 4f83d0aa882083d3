"""python -m blockloom cat [FILE | -]: plaintext of a .bz2 file (default: standard input) on standard output.
python -m blockloom report FILE...: blocks, bytes, lines and a preview of each file, decoded by Spark in ranges of bytes."""

from __future__ import annotations

import os
import sys
import time


def cat(name: str) -> None:
    from .sources.bz2 import blocks_of

    with sys.stdin.buffer if name == "-" else open(name, "rb") as f:
        for out in blocks_of(f):
            sys.stdout.buffer.write(out)


def report(names: list[str]) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .plans import parallel
    from .sources.bz2 import resolve

    spark = SparkSession.builder.getOrCreate()
    began = time.time()
    paths = [resolve(n, os.getcwd()) for n in names]
    blocks = parallel.decode_paths(spark, paths)
    text = F.decode("out", "UTF-8")
    sums = blocks.groupBy("file_id").agg(
        F.count("out").alias("blocks"), F.sum(F.octet_length("out")).alias("bytes"), F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("lines"),
        F.bool_and("fast").alias("fast"), F.count_if(F.col("fast")).alias("chained"), F.max("error").alias("error"), F.min_by(F.substring(text, 1, 480), F.col("block_idx")).alias("head"),
    )
    total = 0
    for r in sums.toLocalIterator():
        total += r.bytes or 0
        print(f"{r.file_id}: {r.blocks} blocks, {r.bytes or 0} bytes, {r.lines or 0} lines, {'parallel' if r.fast else f'{r.chained} by the chain, the rest serial'}{', ' + r.error if r.error else ''}")
        for line in (r.head or "").split("\n")[:3]:
            print(f"  {line[:160]}")
    print(f"{total / 1e6 / (time.time() - began):.1f} MB/s of plaintext")


if __name__ == "__main__":
    command, *rest = sys.argv[1:] or ["cat"]
    if command == "cat":
        cat(rest[0] if rest else "-")
    elif command == "report" and rest:
        report(rest)
    else:
        sys.exit(__doc__)
