"""Problem 7: missing or wrong language labels, and languages of mixed texts.

Texts are cut into sentences and lines. A unit is the TF-IDF vector of the character n-grams of its words (one to three letters with word
ends; ideographs and kana one by one, with their script), hashed into a fixed number of columns. It is compared by cosine with several
centroids for each language, found by spherical k-means; the nearest centroid's language is taken unless it is too far away or too close to that
of another language, then the unit has none. The numerator of the cosine is a sum over words, so each worker keeps a row of sums for each
word it has met; the norm of the vector comes from a count sketch of 64 columns kept in the same way.

The centroids are fitted on ``per_label`` texts for each label (the texts with the least hashes of their ids), a bounded sample; units that
lie nearer to another language's mean than to their label's are dropped, twice, because labels are wrong at times. Everything
else reads all rows.

Defined cases: null content has no languages; a text without a unit that is long and clear enough gets the nearest language of the whole text if it has
three words or ideographs, else none; null, empty and unknown labels count as missing; an empty table gives an empty result; without any
labelled text no language is ever assigned.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS, SKETCH, CENTROIDS = 8192, 64, 3
MOST_REACH = 0.2

# Spellings of the languages' names and codes.
NAMES = {
    "en": ("en", "eng", "english", "anglais", "englisch", "inglés", "英语", "英文", "英語"),
    "zh": ("zh", "zho", "chi", "cmn", "cn", "chinese", "mandarin", "chinois", "chinesisch", "chino", "中文", "汉语", "中国語"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "德语", "ドイツ語"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch", "francés", "法语", "フランス語"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "spanisch", "espagnol", "西班牙语", "スペイン語"),
    "ja": ("ja", "jpn", "jp", "japanese", "japanisch", "japonais", "japonés", "日本語", "日语", "日文"),
}
LANGUAGES = tuple(NAMES)

_unit = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n")
_word = re.compile("[぀-ヿ]|[㐀-䶿一-鿿]|[^\\W\\d_぀-ヿ㐀-䶿一-鿿]+")


def folded_label(label: Column) -> Column:
    """The code of a label in any of its spellings, regions and scripts cut off; null for none or an unknown one."""
    bare = F.regexp_replace(F.lower(F.trim(label)), "[-_].*$", "")
    table = F.create_map(*[F.lit(x) for code, names in NAMES.items() for n in names for x in (n, code)])
    return F.try_element_at(table, bare)


def _grams(word: str) -> list[int]:
    if "぀" <= word <= "ヿ":
        grams = [word, "<kana>"]
    elif "㐀" <= word[0] <= "鿿":
        grams = [word, "<han>"]
    else:
        w = f"_{word}_"
        grams = [*word, *(w[i : i + 2] for i in range(len(w) - 1)), *(w[i : i + 3] for i in range(len(w) - 2))]
    return [zlib.crc32(g.encode()) for g in grams]


def units_of(text: str) -> list[tuple[int, int]]:
    """Places of the sentences and lines that hold something."""
    out, start = [], 0
    for m in _unit.finditer(text):
        if text[start : m.start()].strip():
            out.append((start, m.start()))
        start = m.end()
    if text[start:].strip():
        out.append((start, len(text)))
    return out


@dataclass
class Model:
    centroids: np.ndarray  # (k, COLUMNS), of length 1
    languages: list[str]
    idf: np.ndarray
    reach: float
    margin: float = 0.06
    words: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    used: int = 0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": {}, "rows": np.zeros((0, 0), np.float32), "used": 0}

    def _row(self, word: str) -> int:
        if self.used == len(self.rows):
            grown = np.zeros((max(4096, 2 * len(self.rows)), len(self.languages) + SKETCH), np.float32)
            if self.used:
                grown[: self.used] = self.rows[: self.used]
            self.rows = grown
        row = self.rows[self.used]
        k = len(self.languages)
        for h in _grams(word):
            w = self.idf[h % COLUMNS]
            row[:k] += w * self._by_column[h % COLUMNS]
            s = (h % COLUMNS) * 2654435761 & 0xFFFFFFFF
            row[k + (s >> 26)] += w if s & 0x10000 else -w
        self.words[word] = self.used
        self.used += 1
        return self.used - 1

    def scores(self, units: list[list[str]]) -> np.ndarray:
        """(n, languages): the cosine with the nearest centroid of each language. Every unit has a word."""
        if self.used > 150_000:
            self.words, self.used = {}, 0
            self.rows[:] = 0
        if not hasattr(self, "_by_column"):
            self._by_column = np.ascontiguousarray(self.centroids.T.astype(np.float32))
            self._starts = [self.languages.index(x) for x in dict.fromkeys(self.languages)]
        get, ids = self.words.get, []
        for u in units:
            for w in u:
                i = get(w)
                ids.append(self._row(w) if i is None else i)
        starts = np.concatenate([[0], np.cumsum([len(u) for u in units])[:-1]])
        sums = np.add.reduceat(self.rows[np.array(ids)], starts, axis=0)
        k = len(self.languages)
        cosine = sums[:, :k] / np.maximum(np.linalg.norm(sums[:, k:], axis=1, keepdims=True), 1e-6)
        return np.maximum.reduceat(cosine, self._starts, axis=1)

    @property
    def order(self) -> list[str]:
        return list(dict.fromkeys(self.languages))


def _vectors(units: list[list[str]], idf: np.ndarray | None) -> np.ndarray:
    x = np.zeros((len(units), COLUMNS), np.float32)
    for i, u in enumerate(units):
        for w in u:
            for h in _grams(w):
                x[i, h % COLUMNS] += 1
    if idf is not None:
        x *= idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return x


def fit(texts: DataFrame, per_label: int = 150, units_per_label: int = 600, seed: int = 7) -> Model | None:
    """``texts`` has id, text and label. The sample is bounded by per_label texts and units_per_label units of each label."""
    labelled = texts.select(F.xxhash64("id").alias("h"), "text", folded_label(F.col("label")).alias("code")).where("code is not null and text is not null")
    counts = {r["code"]: r["n"] for r in labelled.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    # a share of the hash space that holds about twice the wanted number; a label has at least one text
    least = F.create_map(*[F.lit(x) for code, n in counts.items() for x in (code, int(min(1.0, 2 * per_label / n) * 2**62))])
    drawn = labelled.where(F.shiftrightunsigned("h", 2) <= F.element_at(least, F.col("code")))
    sample = drawn.groupBy("code").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "text"))), 1, per_label).alias("texts")).collect()
    rng, units, codes = np.random.default_rng(seed), [], []
    for r in sorted(sample, key=lambda r: LANGUAGES.index(r["code"])):
        own = [_word.findall(t["text"][a:b].lower()) for t in r["texts"] for a, b in units_of(t["text"])]
        own = [u for u in own if len(u) >= 5]
        picked = rng.permutation(len(own))[:units_per_label]
        units += [own[i] for i in picked]
        codes += [r["code"]] * len(picked)
    if not units:
        return None
    raw = _vectors(units, None)
    idf = np.log((1 + len(units)) / (1 + (raw > 0).sum(0))).astype(np.float32) + np.float32(0.1)
    raw *= idf
    raw /= np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
    y = np.array([LANGUAGES.index(c) for c in codes])
    keep = np.ones(len(y), bool)
    for _ in range(2):
        present = sorted(set(y[keep].tolist()))
        means = np.stack([raw[keep & (y == c)].mean(0) for c in present])
        means /= np.linalg.norm(means, axis=1, keepdims=True)
        keep = np.array(present)[(raw @ means.T).argmax(1)] == y
    centroids, languages, reach = [], [], []
    for c in sorted(set(y[keep].tolist())):
        x = raw[keep & (y == c)]
        m = x[rng.permutation(len(x))[:CENTROIDS]]
        for _ in range(12):
            near = (x @ m.T).argmax(1)
            m = np.stack([x[near == j].mean(0) if (near == j).any() else m[j] for j in range(len(m))])
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
        centroids.append(m)
        languages += [LANGUAGES[c]] * len(m)
        reach.append(np.quantile((x @ m.T).max(1), 0.005))
    # a sample that is too uniform must not make the model reject what is new to it
    return Model(np.concatenate(centroids), languages, idf, min(MOST_REACH, 0.8 * float(min(reach))))


_SEGMENT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])


def _wide(words: list[str]) -> bool:
    """Long enough to be judged alone."""
    ideographs = sum("぀" <= w <= "鿿" for w in words)
    return ideographs >= 5 or sum(len(w) > 1 for w in words) - ideographs >= 4


def _classify(model: Model, with_segments: bool):
    order = model.order

    def one(text: str, places: list[tuple[int, int]], found: list[list[str]], judged: dict[int, tuple[str, float]], whole: tuple[str, float] | None) -> tuple:
        clear = [judged.get(i) for i in range(len(places))]
        langs: dict[str, float] = {}
        for c in clear:
            if c:
                langs[c[0]] = max(langs.get(c[0], 0.0), c[1])
        if not langs and whole:
            langs = dict([whole])
        segments: list[dict] = []
        if with_segments and langs:
            first = next((c for c in clear if c), whole)
            last = first
            for (a, b), c in zip(places, clear, strict=True):
                last = c or last
                if segments and segments[-1]["lang"] == last[0]:
                    segments[-1]["end"] = b
                    segments[-1]["confidence"] = min(segments[-1]["confidence"], last[1])
                else:
                    segments.append({"start": a, "end": b, "lang": last[0], "confidence": last[1]})
        return sorted(langs), [langs[k] for k in sorted(langs)], segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                places = [units_of(t) for t in texts]
                found = [[_word.findall(t[a:b].lower()) for a, b in p] for t, p in zip(texts, places, strict=True)]
                asked = [(i, j) for i, f in enumerate(found) for j, u in enumerate(f) if _wide(u)]
                judged: list[dict] = [{} for _ in texts]

                def verdict(s: np.ndarray) -> tuple[str, float]:
                    top = np.argsort(s)
                    second = s[top[-2]] if len(s) > 1 else 0.0
                    return order[top[-1]], float(min(1.0, max(0.0, (s[top[-1]] - max(second, 0.0)) / max(s[top[-1]], 1e-6))))

                if asked:
                    s = model.scores([found[i][j] for i, j in asked])
                    if "zh" in order:  # kana never occurs in Chinese
                        kana = np.array([any("぀" <= w <= "ヿ" for w in found[i][j]) for i, j in asked])
                        s[kana, order.index("zh")] = -1.0
                    top = s.max(1)
                    second = np.partition(s, -2, axis=1)[:, -2] if s.shape[1] > 1 else np.zeros(len(s))
                    for k in np.flatnonzero((top >= model.reach) & (top - second >= model.margin)):
                        judged[asked[k][0]][asked[k][1]] = (order[int(s[k].argmax())], float(min(1.0, (top[k] - max(second[k], 0)) / top[k])))
                whole: list = [None] * len(texts)
                rest = [i for i, f in enumerate(found) if not judged[i] and sum(map(len, f)) >= 3]
                if rest:
                    for i, s in zip(rest, model.scores([[w for u in found[i] for w in u] for i in rest]), strict=True):
                        whole[i] = verdict(s)
                rows = [one(*x) for x in zip(texts, places, found, judged, whole, strict=True)]
                yield pa.record_batch(
                    [part.column(0), part.column(2), pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.list_(pa.float64())), pa.array([r[2] for r in rows], pa.list_(_SEGMENT))],
                    names=["id", "code", "langs", "confidences", "segments"],
                )

    return run


def detect(texts: DataFrame, model: Model | None, with_segments: bool = True) -> DataFrame:
    """(id, code, langs, confidences, segments) for each row with a text: the folded label, the languages that the text has sentences in with the
    greatest confidence of each, and its stretches of one language with the least confidence of their sentences."""
    schema = "id string, code string, langs array<string>, confidences array<double>, segments array<struct<start:int,end:int,lang:string,confidence:double>>"
    if model is None:
        return texts.sparkSession.createDataFrame([], schema)
    return texts.where("text is not null").select("id", "text", folded_label(F.col("label")).alias("code")).mapInArrow(_classify(model, with_segments), schema)


def corrections(texts: DataFrame, model: Model | None) -> DataFrame:
    """(id, lang, confidence): a row for each language of a mixed text; one row for a text of one language whose label isn't that language."""
    wrong = ~F.coalesce(F.col("code") == F.get("langs", 0), F.lit(False))
    rows = detect(texts, model, with_segments=False).where((F.size("langs") > 1) | (F.size("langs") == 1) & wrong)
    each = rows.select("id", F.explode(F.arrays_zip("langs", "confidences")).alias("x"))
    return each.groupBy("id", F.col("x.langs").alias("lang")).agg(F.max("x.confidences").alias("confidence"))
