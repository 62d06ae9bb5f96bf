"""Zip archives as rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def expand_archives(files: DataFrame) -> DataFrame:
    """Entries of zip archives given as ``(path, content)``: ``archive, entry, content``.

    Archives are unpacked in parallel, one entry in memory at a time.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                    for info in archive.infolist():
                        if not info.is_dir():
                            row = (path, info.filename, archive.read(info))
                            yield pd.DataFrame([row], columns=["archive", "entry", "content"])

    return files.select("path", "content").mapInPandas(
        unpack, "archive string, entry string, content binary"
    )
