"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents are dealt to shards of bounded size by a hash of the row; a shard is packed in one task. Its pieces
go, longest first, to the open bin that they leave the least room in. Where none has room, a bin opens, and in the end each
bin shrinks to the least permitted capacity that holds it. The lengths are optimised jointly: the shard is packed
once with each permitted length as the one that opens, and once with the one that costs least for each word still to
come; the packing whose bins cost least in all is taken. A capacity's cost is linear (padding) and quadratic (attention) plus a fixed part.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words, text_of

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: About so many words (and an eighth as many documents) are packed in one task.
SHARD = 1 << 20
FIXED_COST = 64.0
SQUARE_COST = 1 / 16384

_GAP = re.compile(r"[\x20\x09-\x0D]+")


def cost(capacity: float) -> float:
    return capacity * (1 + capacity * SQUARE_COST) + FIXED_COST


def _packed(lengths: np.ndarray, capacities: tuple[int, ...], opens: int | None) -> tuple[np.ndarray, list[int]]:
    """Best fit where bins open with capacity `opens` (or the least that fits), or with the cheapest for each word still to come."""
    order = np.argsort(-lengths, kind="stable")
    left, bins = int(lengths.sum()), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    rooms: list[int] = []  # the different rooms of open bins, in order
    by_room: dict[int, list[int]] = {}
    for i in order.tolist():
        size = int(lengths[i])
        at = bisect.bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            bin_no = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        else:
            fit = [c for c in capacities if c >= size]
            room = min(fit, key=lambda c: (cost(c) / min(c, left), -c)) if opens is None else max(opens, fit[0])
            bin_no = len(used)
            used.append(0)
        bins[i] = bin_no
        used[bin_no] += size
        left -= size
        if room > size:
            if room - size not in by_room:
                bisect.insort(rooms, room - size)
                by_room[room - size] = []
            by_room[room - size].append(bin_no)
    return bins, [next(c for c in capacities if c >= u) for u in used]


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES) -> tuple[np.ndarray, list[int]]:
    """Bin number of each piece, and each bin's capacity, of the cheapest packing. Pieces are of one word at least and fit the largest capacity."""
    tried = [_packed(lengths, capacities, opens) for opens in (None, *capacities)]
    return min(tried, key=lambda t: sum(map(cost, t[1])))


def _cut(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of the pieces: a longer document is cut every `most` words."""
    n = -(-lengths // most)
    row = np.repeat(np.arange(len(lengths)), n)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * most
    return row, start, np.minimum(most, lengths[row] - start)


SCHEMA = "doc_id long, piece int, start long, length long, bin_id long, slot int, offset long, capacity int, used int"


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, with_text: bool = False) -> DataFrame:
    """One row for each piece of a document: where it starts in the document and lies in its bin, with the bin's capacity and use.

    A document of more words than the largest capacity is cut there, so that no word is lost. A null or
    word-free text keeps one row with piece 0, length 0 and no bin. Repeated rows are packed each; a null id
    stays null. An empty table gives no rows. Only doc_id and text are looked at. with_text adds the piece's text.
    """
    capacities = tuple(sorted(capacities))
    text = text_of()
    rows = docs.select("doc_id", n_words(text).alias("n"), F.xxhash64("doc_id", text).alias("h"), *([text.alias("text")] if with_text else []))
    total = rows.agg(F.sum("n"), F.count("*")).first()
    shards = max(1, -(-((total[0] or 0) + 8 * total[1]) // SHARD))

    def shard(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "h"], kind="stable", ignore_index=True)
        row, start, length = _cut(group["n"].to_numpy(np.int64), capacities[-1])
        bins, sizes = best_fit(length, capacities)
        order = np.lexsort((np.arange(len(row)), bins))
        row, start, length, bins = row[order], start[order], length[order], bins[order]
        out = pd.DataFrame({"doc_id": group["doc_id"].to_numpy()[row], "piece": start // capacities[-1], "start": start, "length": length, "bin_no": bins})
        out["slot"] = out.groupby("bin_no").cumcount()
        out["offset"] = out.groupby("bin_no")["length"].cumsum() - out["length"]
        out["capacity"] = np.array(sizes, np.int64)[bins]
        out["used"] = out.groupby("bin_no")["length"].transform("sum")
        out["bin_id"] = int(group["shard"].iloc[0]) * (1 << 32) + bins if len(group) else bins
        if with_text:
            texts = group["text"].to_numpy()
            words: dict[int, list[str]] = {}
            pieces = []
            for r, a, k, whole in zip(row.tolist(), start.tolist(), length.tolist(), group["n"].to_numpy()[row].tolist()):
                if k == whole:
                    pieces.append(texts[r])
                else:
                    if r not in words:
                        words[r] = [w for w in _GAP.split(texts[r]) if w]
                    pieces.append(" ".join(words[r][a : a + k]))
            out["text"] = pieces
        return out[list(names)]

    schema = SCHEMA + (", text string" if with_text else "")
    names = [c.split()[0] for c in schema.split(", ")]
    dealt = rows.where("n > 0").withColumn("shard", F.pmod(F.col("h"), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInPandas(shard, schema)
    blank = {"doc_id": F.col("doc_id"), "piece": F.lit(0), "start": F.lit(0), "length": F.lit(0), "text": F.lit("")}
    types = dict(c.split() for c in schema.split(", "))
    return packed.unionByName(rows.where("n = 0").select([blank.get(c, F.lit(None)).cast(types[c]).alias(c) for c in names]))
