"""Encoding and delimiter of a delimited file, from its first bytes."""

from __future__ import annotations

import codecs
import csv
import os

#: Bytes looked at.
SAMPLE = 100_000
# Encodings in the order they are tried.
ENCODINGS = ["utf-8-sig", "utf-8", "cp1256", "windows-1252", "latin1"]
DELIMITERS = ",;\t|"


def encoding_of(head: bytes) -> str:
    """The first encoding that decodes the sample; a code point cut off at its end is no error."""
    for e in ENCODINGS:
        try:
            codecs.getincrementaldecoder(e)().decode(head, final=False)
            return e
        except UnicodeDecodeError:
            continue
    raise ValueError("no known encoding")


def delimiter_of(text: str, path: str = "") -> str:
    try:
        return csv.Sniffer().sniff(text, DELIMITERS).delimiter
    except csv.Error:
        return "\t" if path.endswith(".tsv") else ","


def sniff(path: str) -> tuple[str, str]:
    """(encoding, delimiter) of a local file."""
    with open(path, "rb") as f:
        head = f.read(SAMPLE)
    e = encoding_of(head)
    return e, delimiter_of(codecs.getincrementaldecoder(e)().decode(head, final=False), path)


def dataset_kind(path: str, columns: list[str]) -> str:
    """comments, products or generic, by the names of the columns and of the file."""
    names, name = {c.lower() for c in columns}, os.path.basename(path).lower()
    if "product_id" in names or "comment" in name:
        return "comments"
    return "products" if "price" in names or "product" in name else "generic"


def find_column(columns: list[str], wanted: list[str]) -> str | None:
    """The first of the wanted names that occurs, whatever its case."""
    by = {c.lower(): c for c in columns}
    return next((by[w.lower()] for w in wanted if w.lower() in by), None)
