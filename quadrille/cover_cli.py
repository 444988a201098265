"""Write the coverage of an area expression.

    python -m quadrille.cover_cli --out DIR [--res 16] [--kml DIR] TERM... [@FILE...]

Terms are +area, -area and &area; @FILE stands for the terms in a file, separated by white space.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quadrille.operators import expressions, render


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quadrille.cover_cli", description=__doc__)
    parser.add_argument("--out", "-o", required=True)
    parser.add_argument("--kml", "-k")
    parser.add_argument("--res", "-r", type=int, default=16)
    given = sys.argv[1:] if args is None else args
    # -rect... is a term, not the option -r: what holds a colon and begins with an operator
    terms = [a for a in given if a[:1] == "@" or (a[:1] in "+-&" and ":" in a)]
    known = parser.parse_args([a for a in given if a not in terms])
    spark = SparkSession.builder.getOrCreate()
    words: list[str] = []
    for term in terms:
        words += spark.read.text(term[1:], wholetext=True).first()[0].split() if term.startswith("@") else [term]
    cells = expressions.evaluate(spark, " ".join(words), known.res)
    expressions.write_lines(cells, known.out)
    if known.kml:
        render.kml_document(render.kml_cells(cells)).select("kml").write.mode("overwrite").text(known.kml)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
