"""PDF files without an engine: objects, text with places and fonts, pages to segments.

Read are plain and compressed objects, Flate streams, simple and composite fonts with their maps to Unicode. Not read are encrypted files (an error) and text inside images:
a page with an image and hardly any text is a scan, which an engine of ``operators.recognition`` has to read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

from loomdex.operators.structure import CODE_FONT, FORMULA, MATH, TOC_DOTS, TOC_HEAD, TOC_NUMBER
from loomdex.sources.files import Segment, parser

_object = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_space, _stop = b"\x00\t\n\x0c\r ", b"\x00\t\n\x0c\r ()<>[]{}/%"
_escapes = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}
MOST_DEPTH = 60


class Name(str):
    pass


class Ref(int):
    pass


class Op(str):
    pass


def read(data: bytes, at: int, depth: int = 0):
    """(value, end) of what stands at a place; names, references and operators have types of their own. At the end (None, length)."""
    n = len(data)
    while at < n and data[at] in _space or data[at : at + 1] == b"%":
        at = (data.find(b"\n", at) if b"\n" in data[at:] else n - 1) + 1 if data[at : at + 1] == b"%" else at + 1
    if at >= n or depth > MOST_DEPTH:
        return None, n
    two, c = data[at : at + 2], data[at : at + 1]
    if two == b"<<" or c == b"[":
        items, end, at = [], b">>" if two == b"<<" else b"]", at + (2 if two == b"<<" else 1)
        while True:
            while at < n and data[at] in _space:
                at += 1
            if at >= n or data.startswith(end, at):
                at += len(end)
                break
            value, at = read(data, at, depth + 1)
            if isinstance(value, Op) and value == "R" and len(items) > 1:
                items[-2:] = [Ref(items[-2])]
            elif not isinstance(value, Op) or value in ("true", "false", "null"):
                items.append(None if isinstance(value, Op) and value == "null" else value)
        return (dict(zip(map(str, items[::2]), items[1::2], strict=False)) if end == b">>" else items), at
    if c == b"<":
        end = data.find(b">", at)
        end = n if end < 0 else end
        digits = bytes(x for x in data[at + 1 : end] if x not in _space)
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii", "replace").replace("�", "0")) if re.fullmatch(rb"[0-9A-Fa-f]*", digits) else b"", end + 1
    if c == b"(":
        out, at, open_ = bytearray(), at + 1, 1
        while at < n:
            x = data[at]
            if x == 92 and at + 1 < n:
                y = data[at + 1]
                octal = re.match(rb"[0-7]{1,3}", data[at + 1 : at + 4])
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    at += 1 + len(octal[0])
                else:
                    if y not in b"\r\n":
                        out.append(_escapes.get(y, y))
                    at += 2
                continue
            open_ += (x == 40) - (x == 41)
            at += 1
            if not open_:
                break
            out.append(x)
        return bytes(out), at
    if c == b"/":
        end = at + 1
        while end < n and data[end] not in _stop:
            end += 1
        return Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), data[at + 1 : end].decode("latin-1"))), end
    end = at
    while end < n and data[end] not in _stop:
        end += 1
    if end == at:
        return Op(c.decode("latin-1")), at + 1
    word = data[at:end].decode("latin-1")
    if re.fullmatch(r"[+-]?\d+", word):
        return int(word), end
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+)", word):
        return float(word), end
    return Op(word), end


def _inflate(data: bytes) -> bytes:
    try:
        return zlib.decompressobj().decompress(data)
    except zlib.error:
        return b""


@dataclass
class Run:
    x: float
    y: float
    size: float
    text: str
    font: str


class Document:
    def __init__(self, raw: bytes):
        if not raw.lstrip()[:5] == b"%PDF-":
            raise ValueError("not a PDF")
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        marks = list(_object.finditer(raw))
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", raw):
            raise ValueError("encrypted")
        for m in marks:
            number = int(m[1])
            value, end = read(raw, m.end())
            self.objects[number] = value
            s = re.compile(rb"\s*stream\r?\n").match(raw, end) if isinstance(value, dict) else None
            if s:
                size = value.get("Length")
                stop = s.end() + size if isinstance(size, int) and not isinstance(size, Ref) else raw.find(b"endstream", s.end())
                self.streams[number] = raw[s.end() : stop if stop > 0 else len(raw)]
        for number, value in list(self.objects.items()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                data, first = self.data(number), int(self.get(value.get("First")) or 0)
                heads = data[:first].split()
                for k in range(0, len(heads) - 1, 2):
                    self.objects.setdefault(int(heads[k]), read(data, first + int(heads[k + 1]))[0])

    def get(self, value):
        for _ in range(MOST_DEPTH):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(int(value))
        return None

    def data(self, number: int) -> bytes:
        raw, value = self.streams.get(number, b""), self.objects.get(number)
        filters = self.get(value.get("Filter")) if isinstance(value, dict) else None
        for f in filters if isinstance(filters, list) else [filters] if filters else []:
            if self.get(f) != "FlateDecode":
                return b""
            raw = _inflate(raw)
        return raw

    def pages(self) -> list[dict]:
        root = next((v for v in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), {})
        out: list[dict] = []

        def walk(ref, inherited: dict, seen: frozenset) -> None:
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and int(ref) in seen):
                return
            own = inherited | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    walk(kid, own, seen | ({int(ref)} if isinstance(ref, Ref) else set()))
            else:
                out.append(own | node)

        walk(root.get("Pages"), {}, frozenset())
        return out or [v for v in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Page"]

    def _font(self, ref) -> tuple[str, dict[int, str] | None, int]:
        """(name, map to Unicode, bytes of a code)."""
        font = self.get(ref) or {}
        wide = 2 if font.get("Subtype") == "Type0" else 1
        at = font.get("ToUnicode")
        if not isinstance(at, Ref):
            return str(font.get("BaseFont", "")), None, wide
        cmap, table = self.data(int(at)), {}
        text = lambda b: b.decode("utf-16-be", "replace")
        for kind, body in re.findall(rb"begin(bfchar|bfrange)(.*?)endbf", cmap, re.S):
            values, pos = [], 0
            while pos < len(body):
                v, pos = read(body, pos)
                if v is not None:
                    values.append(v)
            step = 2 if kind == b"bfchar" else 3
            for k in range(0, len(values) - step + 1, step):
                lo = int.from_bytes(values[k], "big")
                if step == 2:
                    table[lo] = text(values[k + 1])
                    continue
                hi, to = int.from_bytes(values[k + 1], "big"), values[k + 2]
                for code in range(lo, min(hi, lo + 65535) + 1):
                    if isinstance(to, list):
                        table[code] = text(to[code - lo]) if code - lo < len(to) else ""
                    else:
                        table[code] = text((int.from_bytes(to, "big") + code - lo).to_bytes(max(2, len(to)), "big"))
        return str(font.get("BaseFont", "")), table, wide

    def runs(self, page: dict) -> tuple[list[Run], float, bool]:
        """(runs with y from the top, height, whether there is an image)."""
        box = self.get(page.get("MediaBox")) or [0, 0, 612, 792]
        height = float(self.get(box[3])) - float(self.get(box[1]))
        resources = self.get(page.get("Resources")) or {}
        fonts = {k: self._font(v) for k, v in (self.get(resources.get("Font")) or {}).items()}
        images = any((self.get(x) or {}).get("Subtype") == "Image" for x in (self.get(resources.get("XObject")) or {}).values())
        contents = page.get("Contents")
        whole = self.get(contents)
        refs = whole if isinstance(whole, list) else [contents]
        data = b"\n".join(self.data(int(r)) for r in refs if isinstance(r, Ref))
        out: list[Run] = []
        stack: list = []
        font, size, leading = ("", None, 1), 1.0, 0.0
        tm, line, base, saved = [1.0, 0, 0, 1.0, 0, 0], [1.0, 0, 0, 1.0, 0, 0], [1.0, 0, 0, 1.0, 0, 0], []

        def times(a: list, b: list) -> list:
            return [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]]

        def show(parts: list) -> None:
            nonlocal tm
            name, table, wide = font
            text = ""
            for p in parts:
                if isinstance(p, (int, float)):
                    text += " " if p < -200 and not text.endswith(" ") else ""
                elif isinstance(p, bytes):
                    codes = [int.from_bytes(p[i : i + wide], "big") for i in range(0, len(p), wide)]
                    text += "".join(table.get(c, "") for c in codes) if table else p.decode("cp1252", "replace")
            m = times(tm, base)
            if text.strip():
                out.append(Run(m[4], height - m[5], abs(size * (m[3] or m[0])), text, name))
            tm = times([1, 0, 0, 1, 0.5 * size * len(text), 0], tm)

        at = 0
        while at < len(data):
            v, at = read(data, at)
            if not isinstance(v, Op):
                stack.append(v)
                continue
            try:
                if v == "BT":
                    tm, line = [1.0, 0, 0, 1.0, 0, 0], [1.0, 0, 0, 1.0, 0, 0]
                elif v == "Tf":
                    font, size = fonts.get(str(stack[-2]), ("", None, 1)), float(stack[-1])
                elif v == "TL":
                    leading = float(stack[-1])
                elif v in ("Td", "TD"):
                    leading = -float(stack[-1]) if v == "TD" else leading
                    tm = line = times([1, 0, 0, 1, float(stack[-2]), float(stack[-1])], line)
                elif v == "Tm":
                    tm = line = [float(x) for x in stack[-6:]]
                elif v in ("T*", "'", '"'):
                    tm = line = times([1, 0, 0, 1, 0, -leading], line)
                    if v != "T*":
                        show([stack[-1]])
                elif v == "Tj":
                    show([stack[-1]])
                elif v == "TJ":
                    show(stack[-1])
                elif v == "cm":
                    base = times([float(x) for x in stack[-6:]], base)
                elif v == "q":
                    saved.append(base)
                elif v == "Q" and saved:
                    base = saved.pop()
                elif v == "BI":  # an image between the operators
                    images, at = True, max(at, data.find(b"EI", at) + 2)
            except (IndexError, TypeError, ValueError):
                pass  # an operator without its operands shows nothing
            stack.clear()
        return out, height, images


def page_count(raw: bytes) -> int:
    """Pages of a PDF; 0 for anything else and for what can't be read."""
    try:
        return len(Document(raw).pages())
    except Exception:  # noqa: BLE001 - a probe never fails
        return 0


def blocks_of(runs: list[Run]) -> list[dict]:
    """Runs to blocks (x0, y0, x1, y1, text, size, bold, is_code): runs of one height are a line, lines that follow closely in one size and column a block."""
    lines: list[list[Run]] = []
    for r in runs:
        if lines and abs(lines[-1][-1].y - r.y) <= 0.3 * max(r.size, 1.0) and r.x >= lines[-1][-1].x:
            lines[-1].append(r)
        else:
            lines.append([r])
    out: list[dict] = []
    for line in lines:
        text = re.sub(r"\s+", " ", " ".join(r.text for r in line)).strip()
        top = max(r.size for r in line)
        fonts = [r.font for r in line]
        code, bold = all(re.search(CODE_FONT, f, re.I) for f in fonts), all("bold" in f.lower() for f in fonts)
        x0, y0, x1, y1 = line[0].x, line[0].y - top, line[-1].x + 0.5 * line[-1].size * len(line[-1].text), line[0].y
        last = out[-1] if out else None
        if last and abs(last["size"] - top) < 0.1 and last["is_code"] == code and last["bold"] == bold and 0 < y1 - last["y1"] <= 1.7 * top and abs(last["x0"] - x0) < 4 * top:
            last.update(text=last["text"] + "\n" + text, y1=y1, x0=min(last["x0"], x0), x1=max(last["x1"], x1))
        else:
            out.append({"x0": x0, "y0": y0, "x1": x1, "y1": y1, "text": text, "size": top, "bold": bold, "is_code": code})
    return out


def _formula(text: str) -> bool:
    return any(re.search(p, text) for p in FORMULA) or sum(c in MATH for c in text) > 0.04 * len(text) > 0


@parser("pdf")
def pdf_segments(raw: bytes, toc_ratio: float = 0.35, levels: int = 6, least_text: int = 80) -> list[Segment]:
    """Blocks of all pages as segments under the headings before them. The commonest size is text, sizes more than 1.06 of it are headings, the largest first. Pages of
    contents are left out. A scanned page gives an empty segment of the kind scan."""
    doc = Document(raw)
    pages = [doc.runs(p) for p in doc.pages()]
    made = [blocks_of(runs) for runs, _, _ in pages]
    counted = Counter(round(b["size"], 1) for page in made for b in page)
    body = counted.most_common(1)[0][0] if counted else 0.0
    sizes = sorted((s for s in counted if s > 1.06 * body), reverse=True)[:levels]
    out: list[Segment] = []
    path: list[tuple[int, str]] = []
    for n, (blocks, (_, _, image)) in enumerate(zip(made, pages, strict=True), 1):
        if image and sum(len(b["text"]) for b in blocks) < least_text:
            out.append((n, n, " > ".join(t for _, t in path), "", "scan", 0))
            continue
        lines = [x.strip() for b in blocks for x in b["text"].split("\n") if x.strip()]
        entries = sum(bool(re.search(TOC_NUMBER, x) or re.search(TOC_DOTS, x)) for x in lines)
        if lines and (entries >= toc_ratio * len(lines) or any(re.search(TOC_HEAD, x, re.I) for x in lines)):
            continue
        for b in blocks:
            level = next((i for i, s in enumerate(sizes, 1) if b["size"] >= s), 0)
            if level:
                title = re.sub(r"\s+", " ", b["text"].split("\n")[0])[:120]
                path = [(k, t) for k, t in path if k < level] + [(level, title)]
            kind = "heading" if level else "code" if b["is_code"] else "formula" if _formula(b["text"]) else "text"
            out.append((n, n, " > ".join(t for _, t in path), b["text"], kind, level))
    return out
