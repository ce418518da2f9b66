"""Language ID: cross-parsing entropy over suffix automata.

For each language a suffix automaton is built over a bounded sample of its labelled text. A
document is parsed greedily into the longest phrases that occur in the sample (a byte that
occurs nowhere is a phrase of its own); phrases times log2(sample length), per byte, estimates
the cross-entropy. The language needing fewest such bits wins, ties to the smaller name.
The score is 2**-bits normalised over the languages.

The sample of a language: pieces of its distinct texts, those of least hash first, up to LANG_BYTES.
A text gives at most PIECE_CHARS characters, or more where a language has few texts; a longer
text gives a piece from a place that its hash names.
So every language with a learnable row is learned, whatever its texts' lengths and ids.

Automata are stored as dense tables in which a missing transition already restarts the parse
and adds to the phrase count. To keep numpy busy, a text is cut into lanes of BLOCK bytes that
advance in lock step, each as if a phrase began at its start. Then every lane's parse is carried
on into the lanes after it until it is in the same state as they were at the same byte; from
there on both agree. What the lanes counted before that point is replaced, so the counts are
those of one parse of the whole text, phrases of any length included.

Defined results: null text, or text without a letter, is `und` with score 0; empty text too; very
long texts are parsed whole, part by part; rows repeat as they come; null ids count as not held
out and aren't learned from; extra columns pass through, and one named as a result column is
replaced; without any labelled text every row is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, held_out, small_batches, table, unused

FOLDS, HELD = 5, 0
LANG_BYTES = 48_000  # bound on the sample of one language
ALL_BYTES = 1_500_000  # bound on all samples together
PIECE_CHARS = 2048  # what one text gives to the sample at most, where there are texts enough
SLOTS = 1024  # bound on sampled texts of a language
BLOCK = 256  # bytes of a lane
CHUNK = 1 << 21  # bytes parsed together

_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[65:91] = _CLEAN[97:123] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)


def clean(text: str) -> np.ndarray:
    """Lower-cased UTF-8; every run of ASCII that isn't a letter becomes one space."""
    b = _CLEAN[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    gap = b == 32
    keep = np.ones(len(b), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    return b[keep]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def suffix_automaton(sample: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring of `sample`; state 0 starts."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in sample:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Parser:
    """Phrase counts of texts against the samples of all languages."""

    def __init__(self, samples: dict[str, bytes]) -> None:
        self.langs = sorted(samples)
        used = sorted(set().union(*samples.values())) if samples else []
        self.k = len(used) + 2  # class 0: a byte in no sample; the last: padding
        self.cls = np.zeros(256, np.int32)
        self.cls[used] = np.arange(1, len(used) + 1)
        self.tables = [self._dense(suffix_automaton(samples[x])) for x in self.langs]
        self.bits = np.array([np.log2(max(len(samples[x]), 2)) for x in self.langs])

    def _dense(self, nxt: list[dict[int, int]]) -> np.ndarray:
        """Entry [state, class] = (next state * k) * 4 + phrases ended by this step."""
        k, root = self.k, nxt[0]
        first = np.ones(k, np.int64)  # a restart from the root on each class
        for c, s in root.items():
            first[self.cls[c]] = s * k * 4
        out = np.tile(first + 1, (len(nxt), 1))
        out[0] = first
        out[:, k - 1] = np.arange(len(nxt)) * k * 4
        for s, arcs in enumerate(nxt):
            for c, to in arcs.items():
                out[s, self.cls[c]] = to * k * 4
        return out.astype(np.int32 if out.max() < 2**31 else np.int64).ravel()

    def phrases(self, texts: list[np.ndarray], states: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """[text, language] counts of the phrases that end inside the texts, and the states after
        them (0: none is open). `states` are those before them, all 0 if not given."""
        sizes = np.array([len(t) for t in texts], np.int64)
        lanes = -(-sizes // BLOCK)
        total = np.zeros((len(texts), len(self.langs)), np.int64)
        after = np.zeros_like(total) if states is None else states.copy()
        if not lanes.sum():
            return total, after
        flat = np.full(lanes.sum() * BLOCK, self.k - 1, np.int32)
        for at, t in zip((np.cumsum(lanes) - lanes) * BLOCK, texts, strict=True):
            flat[at : at + len(t)] = self.cls[t]
        steps = np.ascontiguousarray(flat.reshape(-1, BLOCK).T)
        some = np.flatnonzero(lanes)
        first = (np.cumsum(lanes) - lanes)[some]
        last = first + lanes[some] - 1
        for j, table in enumerate(self.tables):
            n, state = self._parse(steps, table, first, last, after[some, j])
            total[some, j], after[some, j] = n, state
        return total, after

    def _parse(self, steps: np.ndarray, table: np.ndarray, first: np.ndarray, last: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and final states of texts that are lanes first to last, all lanes side by side."""
        n_lanes = steps.shape[1]
        state = np.zeros((BLOCK + 1, n_lanes), table.dtype)
        count = np.zeros((BLOCK + 1, n_lanes), np.int32)
        state[0, first] = start
        for t in range(BLOCK):
            v = table.take(state[t] + steps[t])
            np.add(count[t], v & 3, out=count[t + 1])
            np.right_shift(v, 2, out=state[t + 1])
        is_last = np.zeros(n_lanes, bool)
        is_last[last] = True
        # carry every lane's parse on until it agrees with the lane it runs in
        own = np.flatnonzero(~is_last)
        met_lane, met_step = own + 1, np.zeros(len(own), np.int64)
        extra = np.zeros(len(own), np.int64)
        now = state[BLOCK, own].copy()
        ended = np.zeros(len(own), bool)  # ran to the text's end without agreeing
        live = np.flatnonzero(now != 0)
        while live.size:
            lane, step = met_lane[live], met_step[live]
            v = table.take(now[live] + steps[step, lane])
            now[live] = v >> 2
            extra[live] += v & 3
            step = step + 1
            met_step[live] = step
            apart = now[live] != state[step, lane]
            over = apart & (step == BLOCK)
            stop = over & is_last[lane]
            ended[live[stop]] = True
            on = live[over & ~stop]
            met_lane[on] += 1
            met_step[on] = 0
            live = live[apart & ~stop]
        whole = count[BLOCK].astype(np.int64)
        gain = extra + whole[met_lane] - count[met_step, met_lane]
        gain[ended] = extra[ended]
        plain = (met_lane == own + 1) & ~ended  # agreed in the very next lane
        per_lane = np.zeros(n_lanes + 1, np.int64)
        per_lane[own + 1] = gain
        per_lane[first] = whole[first]
        ends = np.cumsum(per_lane)
        sums = ends[last] - ends[first] + per_lane[first]
        final = state[BLOCK, last].astype(np.int64)
        place = np.full(n_lanes, -1, np.int64)
        place[own] = np.arange(len(own))
        odd = np.searchsorted(first, own[~plain], side="right") - 1
        for d in np.unique(odd):  # follow the lanes that the true parse agrees with
            lane, total = int(first[d]), int(whole[first[d]])
            while lane != last[d]:
                k = place[lane]
                total += int(gain[k])
                if ended[k]:
                    final[d] = now[k]
                    break
                lane = int(met_lane[k])
            sums[d] = total
        return sums, final

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return lang, score
        todo: list[tuple[int, np.ndarray]] = []
        sums: dict[int, np.ndarray] = {}

        def flush() -> None:
            count, state = self.phrases([b for _, b in todo])
            for (i, _), c in zip(todo, count + (state != 0), strict=True):
                sums[i] = c
            todo.clear()

        size = 0
        for i, t in enumerate(texts):
            if not has_letter(t):
                continue
            b = clean(t)
            if len(b) > CHUNK:  # by parts, each starting in the state that the last ended in
                total, state = np.zeros((1, len(self.langs)), np.int64), None
                for at in range(0, len(b), CHUNK):
                    n, state = self.phrases([b[at : at + CHUNK]], state)
                    total += n
                sums[i] = (total + (state != 0))[0]
                continue
            todo.append((i, b))
            size += len(b)
            if size >= CHUNK:
                flush()
                size = 0
        if todo:
            flush()
        for i, c in sums.items():
            bits = c * self.bits
            best = int(np.argmin(bits))
            lang[i] = self.langs[best]
            score[i] = float(1 / np.exp2(np.maximum(bits.min() - bits, -1000)).sum())
        return lang, score


def learn_samples(docs: DataFrame) -> dict[str, bytes]:
    """Sample bytes by language. The texts of a language fall into SLOTS slots by hash; each slot
    offers its text of least hash, so at most SLOTS numbers a language reach the driver. Those of
    least hash that fill LANG_BYTES are then fetched, one row for equal texts."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.filter((fold(F.col("doc_id"), FOLDS) != HELD) & F.col("lang").isNotNull() & (F.length("text") > 0)).select(
        F.col("lang").cast("string").alias("lang"), F.xxhash64(text).alias("h"), text.alias("text")
    )
    rows = rows.withColumn("size", F.length("text").cast("long"))
    slots = rows.groupBy("lang", F.pmod(F.xxhash64("h"), F.lit(SLOTS)).alias("slot")).agg(
        F.min("h").alias("h"), F.min_by("size", "h").alias("size")
    )
    offered: dict[str, list[tuple[int, int]]] = {}
    for r in slots.collect():
        offered.setdefault(r["lang"], []).append((r["h"], r["size"]))
    if not offered:
        return {}
    per_lang = min(LANG_BYTES, max(256, ALL_BYTES // len(offered)))
    wanted = []
    for lang, found in sorted(offered.items()):
        most, enough = PIECE_CHARS, 2 * per_lang  # cleaning shortens texts
        while most < enough and sum(min(size, most) for _, size in found) < enough:
            most *= 2
        chars = 0
        for h, size in sorted(found):
            if chars >= enough:
                break
            wanted.append((lang, h, most))
            chars += min(size, most)
    chosen = spark.createDataFrame(wanted, "wanted_lang string, wanted_h long, most int")
    first = F.pmod(F.xxhash64("h", F.lit(1)), F.greatest(F.col("size") - F.col("most") + 1, F.lit(1))) + 1
    piece = F.col("text").substr(first.cast("int"), F.col("most"))
    picked = (
        rows.join(F.broadcast(chosen), (F.col("lang") == F.col("wanted_lang")) & (F.col("h") == F.col("wanted_h")))
        .select("lang", "h", piece.alias("piece"))
        .dropDuplicates(["lang", "h"])
        .collect()
    )
    out: dict[str, bytearray] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["h"])):
        got = out.setdefault(r["lang"], bytearray())
        if len(got) < per_lang and has_letter(r["piece"]):
            got += clean(r["piece"])[: per_lang - len(got)].tobytes() + b" "
    return {k: bytes(v) for k, v in out.items() if v}


_parsers: dict[int, Parser] = {}


def predict_language(docs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """docs with held_out, lang_pred and score. The samples are broadcast; each Python worker
    builds the automata once."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        key = hash(tuple(sorted(shared.value.items())))
        if key not in _parsers:
            _parsers.clear()
            _parsers[key] = Parser(shared.value)
        for texts in parts:
            lang, score = _parsers[key].predict([None if t is None else t for t in texts])
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    both = unused(docs, "predicted")
    out = docs.withColumn(both, predict(F.col("text").cast("string")))
    found = {"lang_pred": F.col(f"{both}.lang_pred"), "score": F.col(f"{both}.score")}
    if "doc_id" in docs.columns:
        found["held_out"] = held_out(F.col("doc_id"), FOLDS, HELD)
    return out.withColumns(found).drop(both)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = learn_samples(docs.select("doc_id", "text", "lang"))
    return predict_language(docs.select("doc_id", "text"), samples).select("doc_id", "held_out", "lang_pred", "score")
