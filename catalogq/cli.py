"""python -m catalogq.cli clean-products | clean-comments | inventory | profile ..."""

from __future__ import annotations

import argparse

from catalogq import pipelines
from catalogq.session import build_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="catalogq")
    sub = p.add_subparsers(dest="run", required=True)
    for name in ("clean-products", "clean-comments", "inventory", "profile"):
        s = sub.add_parser(name)
        s.add_argument("--input", required=True, nargs="+" if name == "profile" else None, help="the raw CSV, several for a profile; for inventory the comments table")
        s.add_argument("--output", required=True)
        s.add_argument("--force", action="store_true", help="replace an earlier output")
        s.add_argument("--max-rows", type=int)
        if name in ("clean-comments", "inventory"):
            s.add_argument("--products", required=True)
        if name == "inventory":
            s.add_argument("--offers", required=True)
    a = p.parse_args(argv)
    if a.max_rows is not None and a.max_rows < 1:
        p.error("--max-rows must be positive")
    spark = build_session(f"catalogq {a.run}")
    if a.run == "clean-products":
        pipelines.clean_products(spark, a.input, a.output, a.force, a.max_rows)
    elif a.run == "clean-comments":
        pipelines.clean_comments(spark, a.input, a.products, a.output, a.force, a.max_rows)
    elif a.run == "inventory":
        pipelines.category_inventory(spark, a.products, a.offers, spark.read.parquet(a.input), a.output, a.force)
    else:
        pipelines.write_profile(pipelines.profile_files(spark, a.input, a.max_rows), a.output, a.force)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
