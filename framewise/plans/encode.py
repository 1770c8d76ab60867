"""FITS bytes for fixtures: Spark writes them from the given tables so that the decoders have input to read."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BLOCK = 2880
#: Files that Python holds at a time.
FILES = 256


def card(key: str, value) -> str:
    if isinstance(value, bool):
        body = f"{'T' if value else 'F':>20}"
    elif isinstance(value, (int, float)):
        body = f"{value!r:>20}"
    else:
        body = "'" + str(value).replace("'", "''") + "'"
    return f"{key:<8}= {body}".ljust(80)[:80]


def header(entries: list[tuple]) -> bytes:
    text = "".join(card(k, v) for k, v in entries) + "END".ljust(80)
    return text.ljust(-(-len(text) // BLOCK) * BLOCK).encode("ascii")


def padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % BLOCK)


def image(values: np.ndarray, entries: list[tuple] = (), bits: int = -64) -> bytes:
    """A primary image from (planes, height, width) or (height, width)."""
    kinds = {8: ">u1", 16: ">i2", 32: ">i4", -32: ">f4", -64: ">f8"}
    shape = values.shape[::-1]
    axes = [("NAXIS", len(shape)), *[(f"NAXIS{i + 1}", int(n)) for i, n in enumerate(shape)]]
    return header([("SIMPLE", True), ("BITPIX", bits), *axes, *entries]) + padded(values.astype(kinds[bits]).tobytes())


def table(columns: dict[str, tuple[str, np.ndarray]]) -> bytes:
    """An empty primary unit and a binary table of (format, values) columns."""
    kinds = {"B": ">u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}
    dtype = np.dtype([(n, kinds[f[-1]], (int(f[:-1]),)) if len(f) > 1 else (n, kinds[f]) for n, (f, _) in columns.items()])
    rows = np.zeros(len(next(iter(columns.values()))[1]), dtype)
    for n, (_, v) in columns.items():
        rows[n] = v
    fields = [e for i, (n, (f, _)) in enumerate(columns.items(), 1) for e in ((f"TTYPE{i}", n), (f"TFORM{i}", f))]
    return header([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0)]) + header(
        [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", dtype.itemsize), ("NAXIS2", len(rows)), ("PCOUNT", 0), ("GCOUNT", 1),
         ("TFIELDS", len(columns)), *fields]) + padded(rows.tobytes())


def image_files(embeddings: DataFrame) -> DataFrame:
    """(path, content): each embedding as an 8x8 float image with acquisition keywords; every 5th repeats a keyword,
    every 7th has disagreeing exposure aliases."""
    def run(batches):
        for batch in batches:
            out = []
            for i, label, v in zip(batch["vec_id"], batch["label"], batch["embedding"]):
                entries = [("INSTRUME", f"CAM{label}"), ("EXPTIME", float(30 * (1 + i % 4))), ("GAIN", float(i % 3 * 100)), ("CCD-TEMP", float(i % 20 - 10)),
                           ("IMAGETYP", "Light Frame"), ("BUNIT", "adu"), ("BAYERPAT", "RGGB"), ("XBAYROFF", int(i % 2)), ("BSCALE", 2.0), ("BZERO", 1.0)]
                if i % 5 == 0:
                    entries.append(("GAIN", 5.0))
                if i % 7 == 0:
                    entries.append(("EXPOSURE", 1.0))
                out.append((f"frame-{i}.fits", image(np.asarray(v, float).reshape(8, 8), entries)))
                if len(out) == FILES:
                    yield pd.DataFrame(out, columns=["path", "content"])
                    out = []
            yield pd.DataFrame(out, columns=["path", "content"])

    return embeddings.select("vec_id", "label", "embedding").mapInPandas(run, "path string, content binary")


def table_files(part: DataFrame) -> DataFrame:
    """(path, content): one table per partition batch of ``part`` rows, with a column nobody asks for."""
    def run(batches):
        for batch in batches:
            yield pd.DataFrame([(f"part-{batch['p_partkey'].iloc[0]}.fits", table({
                "key": ("K", batch["p_partkey"].to_numpy()), "junk": ("3E", np.zeros((len(batch), 3))), "size": ("I", batch["p_size"].to_numpy()),
                "price": ("D", batch["p_retailprice"].astype(float).to_numpy())}))], columns=["path", "content"])

    return part.select("p_partkey", "p_size", "p_retailprice").mapInPandas(run, "path string, content binary")
