"""python tests/llm/measure_restoration.py TABLES_DIR [DOCS]: of clean held-out documents garbled as a whole by each chain, how many are found and restored exactly."""

import sys
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

from pyspark.sql import functions as F  # noqa: E402

from lexivane.llm import mojibake as M  # noqa: E402
from lexivane.session import local_session, table  # noqa: E402


def main(sf_dir: str, n_docs: int = 60) -> None:
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    docs = table(spark, sf_dir, "documents").where(F.octet_length("text") > F.length("text")).select("doc_id", "text")
    held_out = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10)) == 0
    model = M.fit(docs.where(~held_out))
    clean = docs.where(held_out).join(M.garbled(docs, model=model).select("doc_id"), "doc_id", "left_anti").orderBy(F.xxhash64("doc_id", F.lit(2)))
    texts = [r.text for r in clean.limit(8 * n_docs).collect()]
    rows, made = [], []
    for chain in M.chains():
        n = 0
        for text in texts:
            try:
                g = M.garble(text, chain)
            except UnicodeError:
                continue
            if g != text and M.invert(g, chain) == text:
                rows.append((len(made), g))
                made.append((chain, text))
                n += 1
                if n == n_docs:
                    break
    got = {r.doc_id: r.restored for r in M.garbled(spark.createDataFrame(rows, "doc_id long, text string").repartition(16), model=model).collect()}
    by = defaultdict(lambda: [0, 0, 0])
    for i, (chain, text) in enumerate(made):
        kinds = ("one step" if len(chain) == 1 else "more steps", "written " + chain[0][0] if chain[0][0] in ("utf-8", *M.EAST_ASIAN) else "written single-byte", "read " + ("East Asian" if chain[-1][1] in M.READ_MULTI else "single-byte"))
        for name in (" + ".join(f"{w}>{r}" for w, r in chain), ", ".join(kinds), "all"):
            by[name][0] += 1
            by[name][1] += i in got
            by[name][2] += got.get(i) == text
    for name, (n, found, right) in sorted(by.items(), key=lambda x: (x[0].count(">") > 0, x[0])):
        print(f"{name}: {n} documents, {found / n:.3f} found, {right / n:.3f} restored")


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:3]))
