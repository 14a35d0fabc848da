"""File fixtures in the shapes the original tooling reads and writes."""

from __future__ import annotations

import json
import os
import struct


def write(path: str, text: str) -> str:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def capture(path: str, order: str = "<", n: int = 3, magic: bytes | None = None,
            cut_last: bool = False, header_only: bool = False, ts0: int = 1000) -> str:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    m = magic or (bytes.fromhex("d4c3b2a1") if order == "<" else bytes.fromhex("a1b2c3d4"))
    with open(path, "wb") as f:
        f.write(m + b"\0" * 20)
        if header_only:
            return path
        for i in range(n):
            payload = bytes(10 + i)
            f.write(struct.pack(order + "IIII", ts0 + i, i, len(payload), len(payload)))
            body = payload[: len(payload) // 2] if cut_last and i == n - 1 else payload
            f.write(body)
    return path


def run_log(path: str, **fields) -> str:
    return write(path, json.dumps(fields, indent=4))


def samples(path: str, rows: list[tuple[float, float, float]]) -> str:
    body = "timestamp,cpu_percent,ram_mb\n" + "".join(f"{t},{c},{r}\n" for t, c, r in rows)
    return write(path, body)
