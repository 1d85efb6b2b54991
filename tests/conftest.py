from __future__ import annotations

import struct
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit RGB file without filters."""
    h, w, _ = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture
def clean_root(tmp_path):
    """14 train and 6 val noise images; every class is common in both splits."""
    rng = np.random.default_rng(1)
    for split, n in (("train", 14), ("val", 6)):
        (tmp_path / "images" / split).mkdir(parents=True)
        (tmp_path / "labels" / split).mkdir(parents=True)
        for i in range(n):
            (tmp_path / "images" / split / f"{split[0]}{i:03}.png").write_bytes(png(rng.integers(0, 256, (48, 64, 3), np.uint8)))
            rows = [f"{c} {0.2 + 0.2 * c + i * 0.004:.4f} {0.3 + i * 0.01:.4f} 0.2000 0.1{i:02}0" for c in range(3)]
            (tmp_path / "labels" / split / f"{split[0]}{i:03}.txt").write_text("\n".join(rows) + "\n")
    (tmp_path / "data.yaml").write_text("names: [person, car, cup]\nnc: 3\n")
    (tmp_path / "LICENSE").write_text("free\n")
    return tmp_path
