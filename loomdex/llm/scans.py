"""Problem 5: text of scanned pages - words cut at line ends, misread characters, running headers, page numbers.

Words and pairs of neighbouring words of all texts are counted into a lexicon; what it keeps is a share of all tokens, so it has at most
1 / ``least_share`` entries however large the corpus is, and can be sent to the tasks. A symmetric-delete index holds each of its words by
its folded form (letters that scanners confuse are one letter) and all forms with one letter less; a word that the lexicon lacks looks up
its own in the same way. Candidates are ranked by an edit distance in which confusions are cheap, then by how often they follow the
word before and how frequent they are. Only repairs made of confusions alone are taken, so an unknown name is not corrected to a word.

Defined cases: null and empty texts have no damage; a line break between whole words is no damage; tables, code and formulas are left alone, headings
have no running headers; a long run of letters and digits (an encoded blob) is no word; repeated rows are judged each; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a scanner reads, and what was printed.
CONFUSIONS = {
    "1": ("l", "i"), "0": ("o",), "5": ("s",), "6": ("b",), "8": ("b",), "9": ("g",), "|": ("l", "i"), "!": ("l", "i"), "¢": ("e", "c"), "†": ("t",),
    "ı": ("i",), "€": ("e",), "ﬁ": ("fi",), "ﬂ": ("fl",), "ﬀ": ("ff",), "ﬃ": ("ffi",), "ﬄ": ("ffl",), "rn": ("m",), "vv": ("w",), "ii": ("u",), "cl": ("d",), "nn": ("m",), "l": ("i",), "i": ("l",),
    "li": ("h",), "m": ("rn",), "d": ("cl",),
}
CHEAP = 0.3
#: So many titles are sent to all tasks; more are joined by shuffle.
SMALL = 200_000

# A letter that is read as two is folded to the two, so that confusions which overlap (clianges, clisk) fold alike in any order.
_folded_letters = {"h": "ll", "u": "ll", "w": "vv", "m": "rn", "d": "cl", "i": "l"}
_fold_chars = str.maketrans(_folded_letters | {s: "".join(_folded_letters.get(c, c) for c in m[0]) for s, m in CONFUSIONS.items() if len(s) == 1 and s not in "lmdi"})
_line_pairs = [(seen, meant[0]) for seen, meant in CONFUSIONS.items() if len(seen) == 2 and seen != "li"] + [(s, m[0]) for s, m in CONFUSIONS.items() if len(m[0]) > 1 and not s.isascii()]
_line_chars = str.maketrans({s: m[0] for s, m in CONFUSIONS.items() if len(s) == 1 and len(m[0]) == 1 and s != "l"} | {"i": "l", "ı": "l"})
_lexical = re.compile("[^\\W\\d_぀-ヿ㐀-䶿一-鿿]+(?:['’][^\\W\\d_]+)?")
_token = re.compile(r"[^\s.,;:?()\[\]{}“”\"«»…–—\-‐‑¬­/<>=+*#]+(?:['’][^\s.,;:?()\[\]{}“”\"«»…–—\-‐‑¬­/<>=+*#]+)?")
_blob = re.compile(r"\S{40,}")
_cut = re.compile("([^\\W\\d_぀-ヿ㐀-䶿一-鿿][\\w¢†|'’]*)([-‐‑¬­])[ \t ]*\n[ \t ]*([^\\W\\d_぀-ヿ㐀-䶿一-鿿][\\w¢†|'’]*)")
_hyphen = re.compile("[-‐‑¬­][ \t ]*\n")
_ideograph = re.compile("[぀-ヿ㐀-䶿一-鿿]")
_suspect = re.compile("[¢†ıﬁﬂﬀﬃﬄ|]")
_digit_in_word = re.compile("[^\\W\\d_]{2,}[015]{1,2}[^\\W\\d_]+|[^\\W\\d_]{3,}[^\\W\\d_][15]|[15][^\\W\\d_]{3,}")
_n = "[0-9lIOo|S]{0,3}[0-9lIO][0-9lIOo|S]{0,3}"
_page = re.compile(
    rf"(?:[-–—\[(|~·•=]{{0,2}}\s*{_n}\s*[-–—\])|~·•=]{{0,2}}|(?:p[¢e]?[.,]?|pg\.?|pag[e¢]|p\s?a\s?g\s?e|s[e¢][ıi1l]t[e¢]|s\.|p[áa]g[ıi1l]na|p[áa]g\.|第)\s*{_n}\s*(?:(?:of|/|de|von|sur|共)\s*{_n})?\s*[页頁ページ]{{0,3}}|{_n}\s*(?:/|of|von|de|sur)\s*{_n}|{_n}\s*\|\s*p\s?a\s?g\s?[e¢]|{_n}\s*[页頁]|{_n}\s*ページ)",
    re.IGNORECASE,
)


def fold(word: str) -> str:
    """The word with letters that scanners confuse made one."""
    return word.lower().replace("nn", "rn").translate(_fold_chars)


def fold_line(line: str) -> str:
    """As fold, with no letter made two: for lines, whose words are compared by length and with numbers."""
    w = line.lower()
    for seen, meant in _line_pairs:
        if seen in w:
            w = w.replace(seen, meant)
    return w.translate(_line_chars)


def distance(seen: str, meant: str) -> float:
    """Weighted edit distance: a confusion costs CHEAP, any other edit 1."""
    n, m = len(seen), len(meant)
    d = [[math.inf] * (m + 1) for _ in range(n + 1)]
    d[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            here = d[i][j]
            if here == math.inf:
                continue
            if i < n and j < m:
                d[i + 1][j + 1] = min(d[i + 1][j + 1], here + (seen[i] != meant[j]))
            if i < n:
                d[i + 1][j] = min(d[i + 1][j], here + 1)
            if j < m:
                d[i][j + 1] = min(d[i][j + 1], here + 1)
            for k in (1, 2):
                for to in CONFUSIONS.get(seen[i : i + k], ()) if i + k <= n else ():
                    if meant.startswith(to, j):
                        d[i + k][j + len(to)] = min(d[i + k][j + len(to)], here + CHEAP)
    return d[n][m]


class _Doubtful(dict):
    """Whether a word reads as something else, whatever stands before it."""

    def __init__(self, lex: Lexicon):
        super().__init__()
        self.lex = lex

    def __missing__(self, word: str) -> bool:
        if len(self) > 300_000:
            self.clear()
        self[word] = found = "_" not in word and self.lex.correct(word) is not None
        return found


class Lexicon:
    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int], total: int):
        self.words, self.pairs, self.total = words, pairs, total
        self._index: dict[str, list[str]] | None = None
        self._known: dict[tuple[str, str], str | None] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("doubtful", "_weak_words")} | {"_index": None, "_known": {}}

    @cached_property
    def doubtful(self) -> _Doubtful:
        return _Doubtful(self)

    @staticmethod
    def _less(form: str) -> set[str]:
        return {form, *(form[:i] + form[i + 1 :] for i in range(len(form)))}

    def index(self) -> dict[str, list[str]]:
        if self._index is None:
            made: dict[str, list[str]] = {}
            for w in self.words:
                if len(w) > 2:
                    for key in self._less(fold(w)):
                        made.setdefault(key, []).append(w)
            self._index = made
        return self._index

    def correct(self, word: str, before: str = "") -> str | None:
        """What the word should read, in its letter case, or null where it is sound or unknown."""
        low = word.lower()
        own = self.words.get(low, 0)
        if len(low) < 3 or len(low) > 30 or own and low not in self._weak() or 2 * sum(c.isdigit() for c in low) >= len(low) or _ideograph.search(low):
            return None
        key = (word, before if before in self.words else "")
        if key in self._known:
            return self._known[key]
        if len(self._known) > 200_000:
            self._known.clear()
        index, best = self.index(), None
        for c in {w for k in self._less(fold(low)) for w in index.get(k, ())}:
            if c == low or self.words[c] < 20 * own:
                continue
            d = distance(low, c)
            if d < 1.0:
                rank = (round(d, 3), -math.log1p(self.pairs.get((before, c), 0)) - 0.2 * math.log1p(self.words[c]), c)
                best = min(best, rank) if best else rank
        found = best[2] if best else None
        if found is None and len(low) >= 5 and (_digit_in_word.fullmatch(low) or _suspect.search(low)):
            # a name: no word of the lexicon, but digits or signs stand where letters belong
            plain = "".join((CONFUSIONS[c][0] if c in CONFUSIONS and not c.isalpha() or c in "ıﬁﬂﬀﬃﬄ" else c) for c in low)
            found = plain if plain.isalpha() else None
        if found is not None:
            found = found.upper() if word.isupper() and len(word) > 3 else found[0].upper() + found[1:] if word[0].isupper() else found
        self._known[key] = found
        return found

    def _weak(self) -> set[str]:
        """Words that are in the lexicon but look like misreadings of far commoner ones are still judged."""
        if not hasattr(self, "_weak_words"):
            by_fold: dict[str, list[str]] = {}
            for w in self.words:
                by_fold.setdefault(fold(w), []).append(w)
            self._weak_words = {w for ws in by_fold.values() if len(ws) > 1 for w in ws if any(self.words[x] >= 20 * self.words[w] for x in ws)}
        return self._weak_words


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter[str] = Counter()
    pairs: Counter[tuple[str, str]] = Counter()

    def give() -> pa.RecordBatch:
        keys = [*((w, "") for w in words), *pairs]
        out = pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([*words.values(), *pairs.values()], pa.int64())], names=["a", "b", "n"])
        words.clear()
        pairs.clear()
        return out

    for batch in batches:
        for t in batch.column(0).to_pylist():
            found = [w.lower() for w in _lexical.findall(t)]
            words.update(found)
            pairs.update(zip(found, found[1:]))  # noqa: B905
            if len(words) + len(pairs) > 150_000:
                yield give()
    yield give()


def lexicon(texts: DataFrame, least_share: float = 1e-5, least_count: int = 3) -> Lexicon:
    """Words and pairs of all texts (column text) that make up at least ``least_share`` of all words."""
    counted = texts.where("text is not null").select("text").mapInArrow(_count, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    kept = counted.where(F.col("n") >= least_count)
    total = texts.where("text is not null").select(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    rows = kept.where(F.col("n") >= F.lit(least_share * total)).collect()  # at most 1 / least_share words and as many pairs
    return Lexicon({r["a"]: r["n"] for r in rows if not r["b"]}, {(r["a"], r["b"]): r["n"] for r in rows if r["b"]}, total)


def _slug(text: str) -> str:
    return re.sub("[^a-z0-9]+", "_", text.lower()).strip("_")


def stem(path: str | None) -> str:
    """The name of a file without directory, ending and a last number, as a slug."""
    name = re.split(r"[/\\]", path or "")[-1].lower()
    return _slug(re.sub(r"_\d+$", "", re.sub(r"\.[a-z0-9]+$", "", name)))


_number = re.compile("[0-9lioszg]{1,4}|p|pg|pag|page|seite|p_gina|of|de|von|sur")


@lru_cache(4096)
def _folded(text: str) -> str:
    return fold_line(re.sub(r"\s+", " ", text.strip()))


def _is_header(line: str, title: str | None, name: str) -> bool:
    """The title, or the file's name that was made of it, alone or with a page number and at most one word (a product's name) more, in any
    letter case."""
    if len(line) > max(len(title or ""), len(name)) + 30:
        return False
    if title:
        x, t = fold_line(re.sub(r"\s+", " ", line)), _folded(title)
        if t in x and sum(len(r) > 4 for r in re.findall(r"\w+", x.replace(t, " ", 1))) <= 1:
            return True
    if len(name) < 6:
        return False
    x, t = fold_line(_slug(line)), _folded(name)
    at = f"_{x}_".find(f"_{t}_")
    if at < 0:
        return False
    before, after = (p.split("_") if p else [] for p in (x[:at].strip("_"), x[at + len(t) :].strip("_")))
    return all(map(_number.fullmatch, after)) and sum(not _number.fullmatch(w) for w in before) <= 1


def repair(text: str, title: str | None, lex: Lexicon, name: str = "", headers: bool = True) -> tuple[str, list[str]]:
    """The text as continuous paragraphs, and the kinds of damage that it had: header, page_number, cut_word, misread."""
    damage: set[str] = set()
    lines = []
    raw = text.split("\n")
    for line in raw:
        bare = line.strip()
        if bare and len(raw) > 1 and len(bare) <= 40 and _page.fullmatch(bare):
            damage.add("page_number")
        elif headers and bare and len(raw) > 1 and _is_header(bare, title, name):
            damage.add("header")
        else:
            lines.append(line)
    out = "\n".join(lines)

    def mended(word: str, before: str) -> str:
        return lex.correct(word, before) or word

    def join(m: re.Match) -> str:
        a, sign, b = m.groups()
        if not (b[0].islower() or not b[0].isalpha()):
            return m[0]
        whole = (a + b).lower()
        known = whole in lex.words or mended(a + b, "").lower() in lex.words
        if not known and sign == "-" and a.lower() in lex.words and b.lower() in lex.words and len(a) > 2 and len(b) > 2:
            return m[0]  # a compound
        damage.add("cut_word")
        return a + b

    if _hyphen.search(out):
        out = _cut.sub(join, out)
    before = ""

    def word(m: re.Match) -> str:
        nonlocal before
        w = m[0]
        if "_" in w or len(w) > 30:
            before = ""
            return w
        fixed = lex.correct(w, before)
        before = (fixed or w).lower()
        if fixed and fixed != w:
            damage.add("misread")
            return fixed
        return w

    doubt = lex.doubtful
    if any(doubt[w] for w in set(_token.findall(out))):
        parts, at = [], 0
        for m in _blob.finditer(out):  # encoded blobs are copied
            parts += [_token.sub(word, out[at : m.start()]), m[0]]
            at = m.end()
        out = "".join([*parts, _token.sub(word, out[at:])])
    if damage:
        out = re.sub(r"(?<![.!?:。！？\n|])[ \t]*\n[ \t]*(?=[^\n\s•*|#\-])", " ", out)
        out = re.sub("(?<=[一-鿿぀-ヿ，、]) (?=[一-鿿぀-ヿ])", "", out)
    return out, sorted(damage)


def repaired(records: DataFrame, lex: Lexicon) -> DataFrame:
    """``records`` has tab, rec_key, text, title, kind and doc. (tab, rec_key, text, damage): the damaged ones, mended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tab, key, text, title, kind, doc in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                fixed, damage = repair(text, title, lex, stem(doc), kind != "heading")
                if damage:
                    rows.append((tab, key, fixed, damage))
            c = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(c[0], pa.string()), pa.array(c[1], pa.string()), pa.array(c[2], pa.string()), pa.array(c[3], pa.list_(pa.string()))], names=["tab", "rec_key", "text", "damage"])

    read = records.where("text is not null and kind in ('text', 'figure_caption', 'heading')")
    return read.select("tab", "rec_key", "text", "title", "kind", "doc").mapInArrow(run, "tab string, rec_key string, text string, damage array<string>")


def scanned_records(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """Children of chunks and rows of segments with their document's title. Copies of a scanned file go by any ending, so that all are read."""
    titles = chunks.groupBy(F.col("file_path").alias("doc")).agg(F.max("doc_title").alias("t"))
    a = chunks.where(~F.col("is_parent")).select(
        F.lit("chunks").alias("tab"), F.col("chunk_id").alias("rec_key"), F.col("content").alias("text"), F.col("file_path").alias("doc"), F.col("chunk_type").alias("kind"), F.col("doc_title").alias("title")
    )
    b = segments.select(F.lit("segments").alias("tab"), F.concat("doc", F.lit("#"), "seg_no").alias("rec_key"), "text", "doc", "kind", F.lit(None).cast("string").alias("title"))
    known, open_ = a.where("title is not null"), a.where("title is null").unionByName(b)  # only texts without a title of their own are shuffled
    titles = titles.where("t is not null")
    titles = F.broadcast(titles) if titles.count() <= SMALL else titles  # one file may hold a tenth of all texts
    found = open_.join(titles, "doc", "left").select("tab", "rec_key", "text", "doc", "kind", F.col("t").alias("title"))
    return known.unionByName(found)
