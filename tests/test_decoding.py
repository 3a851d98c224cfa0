"""Incremental decoding of any cut of any bytes, against the loop over chunks."""

from __future__ import annotations

import random

from cairnwork.streaming.decoding import decoded


def by_hand(chunks):
    out, so_far, clean = [], b"", ""
    for seq, c in chunks:
        so_far += c or b""
        text = so_far.decode("utf-8", "replace")
        if not text.endswith("�"):
            if text[len(clean) :]:
                out.append((seq, text[len(clean) :]))
            clean = text
    return out


def test_any_cut_of_any_bytes(spark):
    draw, rows, want = random.Random(13), [], {}
    texts = ["aé中\U0001f600b", "plain", "� end", "\U0001f600" * 6, "\xa0ÿࠀ￿"]
    for stream in range(120):
        raw = "".join(draw.choices(texts, k=4)).encode()
        if stream % 2:  # bytes that are no UTF-8
            raw = bytearray(raw)
            for _ in range(6):
                raw[draw.randrange(len(raw))] = draw.choice([0x80, 0xC0, 0xE2, 0xED, 0xF0, 0xF5, 0xFF, 0x41])
            raw = bytes(raw)
        own, at = [], 0
        while at < len(raw):
            n = draw.choice([0, 1, 1, 1, 2, 3, 5, 9])
            own.append((len(own) * 2, raw[at : at + n] or draw.choice([b"", None])))
            at += n
        rows += [(None if stream == 7 else stream, *c) for c in own]
        want[None if stream == 7 else stream] = by_hand(own)
    draw.shuffle(rows)
    got = {k: [] for k in want}
    for r in decoded(spark.createDataFrame(rows, "id int, seq int, piece binary"), "id", "seq", "piece").orderBy("seq").collect():
        got[r["id"]].append((r["seq"], r["text"]))
    assert got == want
    assert decoded(spark.createDataFrame([], "id int, seq int, piece binary"), "id", "seq", "piece").count() == 0
