"""Problem 10: text that was decoded with the wrong character encoding.

A repair is a chain of up to three steps (wrong, true): encode with the codec that was used by mistake, decode with the one that should have been.
Every line that has a character outside ASCII is rewritten by every chain that applies to it, and each version is compressed with
zstandard dictionaries, one for each language, trained on all texts of its label. The description length of a version is its least
compressed size plus the cost of its chain; the shortest wins, and the line stays as it is unless a chain saves ``least_gain`` bytes. The chain that
saves most over a document is tried first on each of its lines. U+FFFD marks bytes that a decoder has already thrown away: such a line is
always reported, and restored as far as its bytes are left.

Defined cases: null, empty and pure ASCII texts are never garbled; a line of sound but unusual characters stays, because no chain shortens it; repeated
rows are judged each; without labelled texts no dictionary exists and only U+FFFD is reported; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.languages import folded_label

SINGLE = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251")
EAST = ("gb18030", "cp932", "euc_jp")
#: Steps and their costs in bytes: misread UTF-8 is the commonest, text in the older single-byte codecs the rarest.
STEPS: dict[tuple[str, str], int] = {
    **{(w, "utf-8"): 1 for w in (*SINGLE, "gb18030", "cp932")},
    **{("cp1252", t): 2 for t in EAST},
    **{(w, "cp1252"): 2 for w in SINGLE if w != "cp1252"},
    **{(w, t): 10 for w in SINGLE for t in ("mac_roman", "cp437", "cp850") if w != t},
}
#: The share of U+FFFD among the characters beyond ASCII of a version; texts that were never garbled turn into little else.
MOST_LOST = 0.25
#: The share of characters outside the alphabet among the different characters beyond ASCII of a version.
MOST_STRANGE = 0.4
LOSSY = {("gb18030", "utf-8"), ("cp932", "utf-8")}
_beyond = re.compile("[^\x00-\x7f]")
_runs = re.compile("[^\x00-\x7f]+")


def _decoded(codec: str) -> str:
    """The characters of all bytes; bytes that a codec leaves undefined stand for themselves, as lenient decoders have them."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


_TABLE = {w: _decoded(w) for w in SINGLE}
_CHARMAP = {w: codecs.charmap_build(t) for w, t in _TABLE.items()}
#: Characters beyond ASCII that a single-byte codec can give; decoders by ISO 8859-1 leave C1 controls beside those of cp1252.
_KNOWN = {w: frozenset(t[128:]) | (frozenset(map(chr, range(0x80, 0xA0))) if w == "cp1252" else frozenset()) for w, t in _TABLE.items()}
_BYTE = {w: {c: i for i, c in enumerate(t)} for w, t in _TABLE.items()}
_BYTE["cp1252"] |= {chr(i): i for i in range(0x80, 0xA0) if chr(i) not in _BYTE["cp1252"]}


def _class(codec: str, lo: int, hi: int) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(c for c, b in _BYTE[codec].items() if lo <= b <= hi)) + "]"


#: A sequence of UTF-8 as a single-byte codec shows it.
_SEQUENCE = {
    w: re.compile(f"{_class(w, 0xC2, 0xDF)}{_class(w, 0x80, 0xBF)}|{_class(w, 0xE0, 0xEF)}{_class(w, 0x80, 0xBF)}{{2}}|{_class(w, 0xF0, 0xF4)}{_class(w, 0x80, 0xBF)}{{3}}") for w in SINGLE
}
#: Lead bytes of kana, without which no Japanese line is.
_KANA_LEADS = re.compile("[‚ƒ]")
_SIDE_BY_SIDE = re.compile("[^\x00-\x7f]{2,}")


def _encode(text: str, codec: str) -> bytes | None:
    """The bytes that a codec gave the text for, or null where it can't have; U+FFFD becomes a byte that is none of UTF-8."""
    try:
        if codec in EAST:
            return b"".join(p.encode(codec) + b"\xff" for p in text.split("�"))[:-1]
        return codecs.charmap_encode(text, "strict", _CHARMAP[codec])[0]
    except UnicodeEncodeError:
        if codec == "cp1252":
            try:
                return bytes([_BYTE[codec][c] for c in text])
            except KeyError:
                return None
        return None


def _plausible(text: str, high: set[str], step: tuple[str, str]) -> bool:
    """A cheap look at what a step needs: characters of its codec, and sequences of bytes that the other has."""
    wrong, true = step
    if wrong in EAST:
        return any(c >= "\u2e80" for c in high)
    if true == "utf-8":
        return _SEQUENCE[wrong].search(text) is not None
    if not high <= _KNOWN[wrong]:
        return False
    if true == "cp932":
        return _KANA_LEADS.search(text) is not None
    if true in EAST:  # two bytes beyond ASCII for most characters
        n = sum(map(len, _SIDE_BY_SIDE.findall(text)))
        return 2 * n > _beyond_count(text)
    return True


def _beyond_count(text: str) -> int:
    return len(text) - len(text.encode("ascii", "ignore"))


def apply_step(text: str, step: tuple[str, str]) -> str | None:
    """The text as the step has it, or null where the step can't have happened or changes nothing."""
    if step[1] == "utf-8" and step[0] in SINGLE and not _SEQUENCE[step[0]].search(text):
        return None
    raw = _encode(text, step[0])
    if raw is not None:
        try:
            out = raw.decode(step[1], "replace" if step in LOSSY else "strict") if step[1] not in SINGLE else codecs.charmap_decode(raw, "strict", _TABLE[step[1]])[0]
        except UnicodeDecodeError:
            out = None
    else:
        out = None
    if out is None and step[1] == "utf-8" and step[0] in SINGLE:
        out = _partly(text, step[0])  # sound characters beside garbled ones
    if out is None or out == text or "�" in out and out.count("�") > max(1, MOST_LOST * _beyond_count(out)):
        return None
    return out


def _partly(text: str, codec: str) -> str:
    """Runs beyond ASCII that are valid UTF-8 as bytes of a single-byte codec are decoded, other runs stay."""

    def run(m: re.Match) -> str:
        raw = _encode(m[0], codec)
        try:
            return raw.decode("utf-8") if raw else m[0]
        except UnicodeDecodeError:
            return m[0]

    return _runs.sub(run, text)


#: A sign inside a word, which no codec puts there by being right.
_broken = re.compile("[^\\W\\d_][^\\w\\s\\x00-\\x7f’‐‑][^\\W\\d_]")
Chain = tuple[tuple[str, str], ...]
MOST_STEPS = 3


def versions(line: str, alphabet: frozenset[str] | None = None, weight: dict[str, float] | None = None) -> Iterator[tuple[Chain, str]]:
    """Every chain of at most MOST_STEPS steps that applies: any step first and after misread UTF-8, misread UTF-8 after a step between single-byte
    codecs. Chains that lead to a version already met aren't followed. With an alphabet, versions whose last step is one between single-byte codecs and gives a
    character outside it, which the line doesn't have, are not given; with the logarithms of how many of the language's texts have a character, nor are those
    whose new characters aren't commoner than the old ones."""
    own, met, front = set(_beyond.findall(line)), {line}, [((), line)]
    for _ in range(MOST_STEPS):
        ahead: list[tuple[Chain, str]] = []
        for chain, text in front:
            high = set(_beyond.findall(text)) if chain else own
            last, beside = chain[-1] if chain else None, _SIDE_BY_SIDE.search(text) is not None
            sequences = beside and not _LEADS.isdisjoint(high) and _SEQUENCE_ANY.search(text) is not None
            for step in STEPS:
                wrong, true = step
                between = true in SINGLE
                if last and (step in LOSSY or last[1] in SINGLE and true != "utf-8" or last[1] == wrong):
                    continue
                known = True
                if between:
                    if not high <= _KNOWN[wrong]:
                        continue
                    table, bytes_ = _TABLE[true], _BYTE[wrong]
                    image = {c: table[bytes_[c]] for c in high}
                    known = alphabet is None or set(image.values()) - own <= alphabet
                    known = known and (weight is None or sum(weight.get(v, RAREST) - weight.get(c, RAREST) for c, v in image.items()) > COMMONER)
                    if not known and not beside:
                        continue
                elif not (sequences if true == "utf-8" and wrong in SINGLE else _plausible(text, high, step)):
                    continue
                made = apply_step(text, step)
                if made is None or made in met or not (known or _SEQUENCE_ANY.search(made)):
                    continue
                met.add(made)
                if known:
                    yield (*chain, step), made
                if true not in EAST and step not in LOSSY and not made.isascii():
                    ahead.append(((*chain, step), made))
        front = ahead


_LEADS = frozenset(c for w in SINGLE for c, b in _BYTE[w].items() if 0xC2 <= b <= 0xF4)
_SEQUENCE_ANY = re.compile("|".join(r.pattern for r in _SEQUENCE.values()))


#: Bytes that a character outside a language's alphabet costs beside its own, as an escape does; an ideograph stands for two others.
ESCAPE = 6
#: The logarithm of the share of texts for a character that hardly any has, and by how much the characters of a version must be commoner.
RAREST, COMMONER = -8.0, 0.5
#: Of zstandard: for the choice of the language, and for the description length, as only the optimal parser finds short descriptions of short lines.
FAST, BEST = 3, 17


class Lengths:
    """Description lengths by the dictionaries and alphabets of the languages."""

    def __init__(self, dictionaries: dict[str, bytes], alphabets: dict[str, set[str]], weights: dict[str, dict[str, float]] | None = None):
        self.dictionaries = dictionaries
        self.weights = weights or {}
        west = set().union(*(a for x, a in alphabets.items() if x not in ("zh", "ja")))  # typographic signs and loan words are common to them
        alphabets = {x: a if x in ("zh", "ja") else west for x, a in alphabets.items()}
        self.alphabet = frozenset(set().union(*alphabets.values()))
        self._strange = {x: re.compile("[^\x00-\x7f" + "".join(map(re.escape, sorted(a))) + "]") for x, a in alphabets.items()}
        self._made: dict[tuple[str, int], zstandard.ZstdCompressor] = {}
        self._hopeless: dict[frozenset[str], bool] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": {}, "_hopeless": {}}

    def size(self, language: str, text: str, level: int = BEST) -> int:
        raw = text.encode("utf-8", "replace")
        c = self._made.get((language, level))
        if c is None:
            d = zstandard.ZstdCompressionDict(self.dictionaries[language])
            d.precompute_compress(level=level)
            c = self._made[language, level] = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        # every character beyond ASCII counts as two bytes, whatever UTF-8 takes for it
        beyond = _beyond_count(text)
        strange = sum(2 if x >= "\u2e80" else 1 for x in self._strange[language].findall(text))
        return len(c.compress(raw)) + 2 * beyond - (len(raw) - len(text) + beyond) + ESCAPE * strange

    def strange(self, language: str, text: str) -> set[str]:
        return set(self._strange[language].findall(text))

    def fitting(self, text: str) -> list[str]:
        """Languages that write in the script of most of the text's letters beyond ASCII."""
        east = len(re.findall("[぀-ヿ㐀-䶿一-鿿｡-ﾟ]", text))
        return [x for x in self.dictionaries if (x in ("zh", "ja")) == (3 * east > len(text) / 3)] or list(self.dictionaries)

    def hopeless(self, line: str) -> bool:
        """Whether no step applies to a line, whatever its language. Without two characters beyond ASCII in a row that hangs on the set of its characters alone."""
        runs = _runs.findall(line)
        if any(len(r) > 1 for r in runs):
            return False
        key = frozenset(runs)
        if key not in self._hopeless:
            if len(self._hopeless) > 100_000:
                self._hopeless.clear()
            every = "\n".join(sorted(key))
            self._hopeless[key] = all(next(versions(every, self.alphabet, w), None) is None for w in self.weights.values() or [None])
        return self._hopeless[key]

    def language(self, text: str, languages: list[str]) -> str:
        return languages[0] if len(languages) == 1 else min((self.size(x, text, FAST), x) for x in languages)[1]


def repair(text: str, lengths: Lengths, least_gain: int = 1) -> tuple[str, list[str], bool]:
    """(restored text, chains used, whether something is lost for good)."""
    if text.isascii():
        return text, [], False
    lines = text.split("\n")
    known = bool(lengths.dictionaries)
    open_ = [i for i, line in enumerate(lines) if known and not line.isascii() and not lengths.hopeless(line)]
    weight = lengths.weights.get(lengths.language(text, lengths.fitting(text))) if open_ else None
    options: dict[int, list[tuple[int, Chain, str]]] = {}
    totals: Counter[Chain] = Counter()
    for i in open_:
        line, made = lines[i], {}
        for chain, version in versions(line, lengths.alphabet, weight):
            made.setdefault(version, chain)
        if not made:
            continue
        own = lengths.language(line, lengths.fitting(line))
        before = lengths.size(own, line)
        for version, chain in made.items():
            fit = lengths.fitting(version)
            # what a chain restores must be known: all of it by codecs of single bytes, which fit any text, most of it by others. Only two
            # and more sequences of UTF-8 are no chance
            language = own if own in fit else lengths.language(version, fit)
            new = lengths.strange(language, version) - set(line)
            beyond = [c for c in version if c > "\x7f"]
            sure = len(beyond) > 1 and all(s[1] == "utf-8" and s not in LOSSY for s in chain)
            if new and not sure and (chain[-1][1] in SINGLE or MOST_STRANGE * len(set(beyond)) < len(new)):
                continue
            if chain[-1][1] in SINGLE and len(_broken.findall(version)) > len(_broken.findall(line)):
                continue
            if chain[-1][1] in SINGLE[1:] and not lengths.strange(own, line):
                continue  # the rarest steps are for lines whose characters aren't known
            gain = before - lengths.size(language, version) - sum(STEPS[s] for s in chain)
            if gain > 0:
                options.setdefault(i, []).append((gain, chain, version))
                totals[chain] += gain
    out, used = list(lines), []
    if totals:
        chief = max(totals, key=lambda c: (totals[c], -len(c), c))
        for i, made in options.items():
            gain, chain, version = max(made, key=lambda x: (x[0] + 2 * (x[1] == chief), -len(x[1])))
            if gain >= least_gain or chain == chief and totals[chief] >= least_gain and gain > 0:
                out[i] = version
                used.append("+".join(f"{w}>{t}" for w, t in chain))
    restored = "\n".join(out)
    return restored, sorted(set(used)), "�" in text


def _misread(line: str, common: set[str]) -> bool:
    """Whether the line reads as UTF-8 by some codec, and then has common characters only."""
    if "�" in line:
        return True
    if line.isascii() or _LEADS.isdisjoint(line):
        return False
    runs = " ".join(_SIDE_BY_SIDE.findall(line))
    made = ((w, apply_step(line, (w, "utf-8"))) for w in SINGLE if _SEQUENCE[w].search(runs))
    return any(v is not None and (w == "cp1252" or set(v) - set(line) <= common) for w, v in made)


#: Bytes of texts that one task trains a dictionary on, how many dictionaries one task merges, and how many times smaller than its part a dictionary to merge is.
PART, FAN, FOLD = 64 << 20, 16, 16
#: Bytes of a sample at most: the trainer counts nothing beyond 128 KB of one. A merged dictionary has no lines and is cut into pieces like them.
SAMPLE, PIECE = 1 << 16, 256
#: A character is known where more lines than one for so many texts have it.
TEXTS_A_LINE = 1500
#: The repeat offsets that end the header of a trained dictionary.
_REPEATS = b"\1\0\0\0\4\0\0\0\10\0\0\0"
_FITTED = "code string, part long, dictionary binary, final boolean, chars array<string>, counts array<long>"


def _pieces(lines: list[bytes], size: int) -> list[bytes]:
    return [x if len(x) <= size else x[i : i + size] for x in lines for i in range(0, len(x), size)]


def _dictionary(lines: list[bytes], size: int) -> bytes:
    """A dictionary from all the lines, none of which is kept for tests alone."""
    for piece in (SAMPLE, PIECE):
        try:
            return zstandard.train_dictionary(size, _pieces(lines, piece), split_point=1.0).as_bytes()
        except zstandard.ZstdError:  # too few lines
            whole = b"\n".join(lines)
            if len(whole) <= size:
                return whole
    return whole[-size:]


def _content(dictionary: bytes) -> bytes:
    """What a dictionary holds beside its header, if it has one."""
    return dictionary[dictionary.index(_REPEATS) + len(_REPEATS) :] if dictionary.startswith(b"\x37\xa4\x30\xec") else dictionary


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, kind, c, n): the texts and their bytes, the texts that have a character, and those that have only its other case."""
    n: defaultdict[tuple[str, str], Counter[str]] = defaultdict(Counter)
    for batch in batches:
        for t, code in zip(batch.column("text").to_pylist(), batch.column("code").to_pylist(), strict=True):
            n[code, "texts"][""] += 1
            n[code, "bytes"][""] += len(t.encode())
            if not t.isascii():
                own = {c for c in set(t) if c > "\x7f"}
                n[code, "own"].update(own)
                n[code, "case"].update({v for x in own if x.lower() != x.upper() for v in (x.lower(), x.upper()) if len(v) == 1} - own)
    rows = [(*key, c, k) for key, counts in n.items() for c, k in counts.items()]
    keys = list(zip(*rows, strict=True)) or [[]] * 4
    yield pa.record_batch([*(pa.array(k, pa.string()) for k in keys[:3]), pa.array(keys[3], pa.int64())], names=["code", "kind", "c", "n"])


def _lines_of(rare: dict[str, set[str]], common: dict[str, set[str]], parts: dict[str, int]):
    """(code, part, h, lines): the lines of each text that may be learned, dealt out to the parts of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, t, code in zip(*(batch.column(x).to_pylist() for x in ("h", "text", "code")), strict=True):
                clean = [x for x in t.split("\n") if len(x) >= 8 and (x.isascii() or rare[code].isdisjoint(x) and not _misread(x, common[code]))]
                k = parts[code]
                rows += [(code, (h + i) % k, h, "\n".join(clean[i::k])) for i in range(min(k, len(clean)))]
            c = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string())], names=["code", "part", "h", "lines"])

    return run


def _fitted(code: str, part: int, dictionary: bytes, final: bool, seen: Counter[str]) -> pa.Table:
    types = {"code": pa.string(), "part": pa.int64(), "dictionary": pa.binary(), "final": pa.bool_(), "chars": pa.list_(pa.string()), "counts": pa.list_(pa.int64())}
    row = (code, part, dictionary, final, list(seen), list(seen.values()))
    return pa.table([pa.array([v], t) for v, t in zip(row, types.values(), strict=True)], names=list(types))


def _fit(parts: dict[str, int], size: int, part_bytes: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        code, part = (k.as_py() for k in key)
        rows = sorted(zip(table.column("h").to_pylist(), table.column("lines").to_pylist(), strict=True))
        lines = [x for _, t in rows for x in t.split("\n")]
        seen = Counter(c for x in lines if not x.isascii() for c in set(x) if c > "\x7f")
        final = parts[code] == 1
        return _fitted(code, part, _dictionary([x.encode() for x in lines], size if final else max(size, part_bytes // FOLD)), final, seen)

    return run


def _merge(left: dict[str, int], size: int, part_bytes: int):
    """One dictionary for each group of them; that of a label with a single group is final."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        code, part = key[0].as_py(), key[1].as_py()
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        seen: Counter[str] = Counter()
        for r in rows:
            seen.update(dict(zip(r["chars"], r["counts"], strict=True)))
        if rows[0]["final"]:
            return _fitted(code, part, rows[0]["dictionary"], True, seen)
        final = left[code] == 1
        return _fitted(code, part, _dictionary(_pieces([_content(r["dictionary"]) for r in rows], PIECE), size if final else max(size, part_bytes // FOLD)), final, seen)

    return run


def train(documents: DataFrame, size: int = 64_000, part_bytes: int = PART) -> Lengths:
    """Dictionaries, alphabets and shares of characters from the texts of each label, all of them. Lines with a character that fewer than four in a thousand
    texts of the label have, or with misread UTF-8, are left out. A label of more than ``part_bytes`` is dealt out to parts by hash; each trains a dictionary on all its
    lines, and the dictionaries are trained on in turn, FAN at a time, until one is left."""
    labelled = documents.where("text is not null").select(F.xxhash64("doc_id").alias("h"), "text", folded_label(F.col("lang")).alias("code")).where("code is not null")
    tally = labelled.select("text", "code").mapInArrow(_tally, "code string, kind string, c string, n long").groupBy("code", "kind", "c").agg(F.sum("n").alias("n")).collect()
    n: dict[str, dict[str, Counter[str]]] = {r["code"]: {"texts": Counter(), "bytes": Counter(), "own": Counter(), "case": Counter()} for r in tally}
    for r in sorted(tally, key=lambda r: r["c"]):
        n[r["code"]][r["kind"]][r["c"]] = r["n"]
    if not n:
        return Lengths({}, {})
    texts = {x: v["texts"][""] for x, v in n.items()}
    df = {x: {c: k for c, k in v["own"].items() if not "㐀" <= c <= "鿿"} for x, v in n.items()}
    rare = {x: {c for c, k in v.items() if k < max(2, 0.004 * texts[x])} for x, v in df.items()}
    common = {x: {c for c, k in v.items() if k >= 0.03 * texts[x]} for x, v in df.items()}
    parts = {x: max(1, math.ceil(v["bytes"][""] / part_bytes)) for x, v in n.items()}
    lines = labelled.mapInArrow(_lines_of(rare, common, parts), "code string, part long, h long, lines string")
    fitted, left = lines.groupBy("code", "part").applyInArrow(_fit(parts, size, part_bytes), _FITTED), parts
    while max(left.values()) > 1:
        left = {x: math.ceil(k / FAN) for x, k in left.items()}
        fitted = fitted.groupBy("code", F.floor(F.col("part") / FAN).alias("group")).applyInArrow(_merge(left, size, part_bytes), _FITTED)
    out, alphabets = {}, dict.fromkeys(sorted(n), frozenset())
    for r in sorted(fitted.collect(), key=lambda r: r["code"]):
        out[r["code"]] = bytes(r["dictionary"])
        known = [c for c, k in zip(r["chars"], r["counts"], strict=True) if k > max(1, texts[r["code"]] / TEXTS_A_LINE)]
        alphabets[r["code"]] = {v for c in known for v in (c, c.upper(), c.lower()) if len(v) == 1}
    weights = {x: {c: max(RAREST, math.log(k / texts[x])) for c, k in (v["own"] + v["case"]).items()} for x, v in sorted(n.items())}
    return Lengths(out, alphabets, weights)


def repaired(documents: DataFrame, lengths: Lengths, least_gain: int = 1) -> DataFrame:
    """(doc_id, text, chains, lost): the garbled documents only, with what could be restored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text, chains, lost = repair(t, lengths, least_gain)
                if chains or lost:
                    rows.append((i, text, chains, lost))
            c = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), pa.array(c[2], pa.list_(pa.string())), pa.array(c[3], pa.bool_())], names=["doc_id", "text", "chains", "lost"])

    return documents.where(F.col("text").rlike("[^\\x00-\\x7f]")).select("doc_id", "text").mapInArrow(run, "doc_id bigint, text string, chains array<string>, lost boolean")
