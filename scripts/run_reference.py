"""Run the named queries on the reference's own CSV tables.

Usage: python scripts/run_reference.py CSV_DIR OUT_DIR [query ...]

CSV_DIR holds the eight files under their reference names (header rows,
``dim_delivery_partner_.csv`` included). Every query result is written as
Parquet to OUT_DIR/<query>; the reference calendar (Jan-May / Jun-Jul /
Aug-Sep 2025) and parameters apply.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from phaselens.plans.registry import model_queries  # noqa: E402
from phaselens.session import get_session  # noqa: E402
from phaselens.sources.bindings import Model  # noqa: E402
from phaselens.sources.readers import read_reference_csv  # noqa: E402
from phaselens.sources.sinks import write_result  # noqa: E402


def run(spark, csv_dir: str, out_dir: str, names: list[str] | None = None) -> list[str]:
    model = Model.from_reference(read_reference_csv(spark, csv_dir))
    done = []
    for name, fn in model_queries().items():
        if names and name not in names:
            continue
        write_result(fn(model), os.path.join(out_dir, name))
        done.append(name)
    return done


def main() -> None:
    csv_dir, out_dir, names = sys.argv[1], sys.argv[2], sys.argv[3:]
    spark = get_session()
    for name in run(spark, csv_dir, out_dir, names or None):
        print("wrote", os.path.join(out_dir, name))
    spark.stop()


if __name__ == "__main__":
    main()
