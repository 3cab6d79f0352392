"""Chunkers: pure functions from a file's bytes to spans, run over files by mapInArrow (a file's cuts depend on its earlier cuts; files are independent)."""

from __future__ import annotations

import ast
import bisect
import json
import re
import tomllib
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import paths

TARGET, MAX, MIN, OVERLAP = 2000, 8000, 400, 200
VERSIONS = {"line-window": 1, "markdown": 1, "go": 1, "python": 1}


@dataclass
class Chunk:
    byte_start: int
    byte_end: int
    heading_path: str = ""
    heading_level: int = 0
    lang: str = ""
    symbol: str = ""
    receiver: str = ""
    decl_kind: str = ""
    signature: str = ""
    exported: bool = False
    package: str = ""
    scope_path: str = ""
    imports_used: list[str] = field(default_factory=list)


@dataclass
class Chunks:
    chunks: list[Chunk]
    title: str = ""
    front_matter: str | None = None
    generated: bool = False


def weight(data: bytes) -> int:
    """Characters that aren't white space."""
    return sum(map(len, data.decode("utf-8", "replace").split()))


def trimmed(data: bytes, start: int, end: int) -> int:
    """end, moved back over trailing white space."""
    return start + len(data[start:end].rstrip())


def line_spans(data: bytes) -> list[tuple[int, int]]:
    ends = [m.end() for m in re.finditer(rb"\n", data)]
    if not ends or ends[-1] < len(data):
        ends.append(len(data))
    return [(a, b) for a, b in zip([0, *ends], ends, strict=False) if b > a]


def line_window(data: bytes) -> Chunks:
    """Windows of lines up to TARGET, each sharing about OVERLAP with the one before; white space alone is no window."""
    lines = line_spans(data)
    weights = [weight(data[a:b]) for a, b in lines]
    out, first = [], 0
    while first < len(lines):
        last, total = first, 0
        while last < len(lines) and total < TARGET:
            total += weights[last]
            last += 1
        start = lines[first][0]
        end = trimmed(data, start, lines[last - 1][1])
        if end > start:
            out.append(Chunk(start, end))
        if last == len(lines):
            break
        again, shared = last, 0
        while again - 1 > first and shared + weights[again - 1] <= OVERLAP:
            again -= 1
            shared += weights[again]
        first = max(again, first + 1)
    return Chunks(out)


def simple_yaml(text: str) -> dict | None:
    """Flat front matter: key: scalar, and lists in brackets or dashes. Anything else isn't taken as front matter."""
    out: dict = {}
    key = None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if (m := re.match(r"\s*-\s+(.*)$", line)) and key is not None and (out[key] is None or isinstance(out[key], list)):
            out[key] = [*(out[key] or []), scalar(m[1])]
        elif m := re.match(r"([A-Za-z_][\w-]*):(?:\s+(.*))?$", line):
            key, value = m[1], (m[2] or "").strip()
            if value.startswith("["):
                if not value.endswith("]"):
                    return None
                out[key] = [scalar(x) for x in value[1:-1].split(",") if x.strip()]
            else:
                out[key] = scalar(value) if value else None
        else:
            return None
    return out or None


def scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text in ("true", "false"):
        return text == "true"
    if text in ("null", "~", ""):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def front_matter(data: bytes) -> tuple[int, dict | None]:
    """Where the body begins, and what stands before it between --- (YAML) or +++ (TOML) lines; malformed is body."""
    m = re.match(rb"(---|\+\+\+)\r?\n", data)
    if not m:
        return 0, None
    close = re.compile(rb"^" + re.escape(m[1]) + rb"\r*(?:\n|\Z)", re.M).search(data, m.end())
    if not close:
        return 0, None
    try:
        text = data[m.end() : close.start()].decode()
        parsed = simple_yaml(text) if m[1] == b"---" else tomllib.loads(text) or None
        json.dumps(parsed, default=str)
    except ValueError:
        return 0, None
    return (close.end(), parsed) if parsed else (0, None)


@dataclass
class Block:
    start: int
    end: int
    weight: int
    fence: bool = False
    lang: str = ""
    level: int = 0
    title: str = ""


_fence = re.compile(r" {0,3}(`{3,}|~{3,})\s*([^\s`]*)[^`]*$")
_heading = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_rule = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_item = re.compile(r" {0,3}(?:[-+*]|\d{1,9}[.)])(?:[ \t]|$)")


def blocks_of(data: bytes, begin: int) -> list[Block]:
    """Top-level blocks: headings, fences, tables and lists whole, paragraphs. A thematic break belongs to the block before."""
    starts: list[tuple[int, dict]] = []
    lines = [(a + begin, data[begin:][a:b].decode("utf-8", "replace").rstrip("\r\n")) for a, b in line_spans(data[begin:])]
    kind, i = None, 0
    while i < len(lines):
        at, line = lines[i]
        if m := _fence.match(line):
            mark, close = m[1], re.compile(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$")
            j = i + 1
            while j < len(lines) and not close.match(lines[j][1]):
                j += 1
            if kind != "list" or not line.startswith(" "):
                starts.append((at, {"fence": True, "lang": m[2]}))
                kind = "fence"
            i = j + 1
            assert mark
            continue
        if m := _heading.match(line):
            starts.append((at, {"level": len(m[1]), "title": (m[2] or "").strip()}))
            kind = "heading"
        elif not line.strip():
            kind = "list gap" if kind in ("list", "list gap") else None
        elif kind == "paragraph" and re.match(r" {0,3}(=+|-+)[ \t]*$", line):
            starts[-1] = (starts[-1][0], {"level": 1 if "=" in line else 2, "title": lines[i - 1][1].strip()})
            kind = "heading"
        elif _rule.match(line):
            kind = None
        elif _item.match(line):
            if kind not in ("list", "list gap"):
                starts.append((at, {}))
            kind = "list"
        elif kind in ("list", "list gap") and (line.startswith((" ", "\t")) or kind == "list"):
            kind = "list"
        elif kind in ("paragraph", "quote") and not (line.startswith(">") and kind == "paragraph"):
            pass
        else:
            starts.append((at, {}))
            kind = "quote" if line.startswith(">") else "paragraph"
        i += 1
    out = []
    for (start, more), end in zip(starts, [*(s for s, _ in starts[1:]), len(data)], strict=True):
        end = trimmed(data, start, end)
        if end > start:
            out.append(Block(start, end, weight(data[start:end]), **more))
    return out


@dataclass
class Section:
    path: str
    level: int
    blocks: list[Block]

    @property
    def weight(self) -> int:
        return sum(b.weight for b in self.blocks)


def markdown(data: bytes) -> Chunks:
    """A chunk for each section (a heading to the next); small sections join the next of their level and ancestors, large ones split between
    blocks, and a large fence stands alone with its language."""
    begin, meta = front_matter(data)
    sections, above = [Section("", 0, [])], []
    for b in blocks_of(data, begin):
        if b.level:
            above = [(level, title) for level, title in above if level < b.level]
            sections.append(Section(" > ".join(t for _, t in above), b.level, [b]))
            above.append((b.level, b.title))
        else:
            sections[-1].blocks.append(b)
    sections = [s for s in sections if s.blocks]
    merged: list[Section] = []
    open_ = False
    for s in sections:
        last = merged[-1] if merged else None
        if open_ and last.weight < MIN and (last.level, last.path) == (s.level, s.path) and last.weight + s.weight <= TARGET:
            last.blocks += s.blocks
        else:
            merged.append(Section(s.path, s.level, list(s.blocks)))
        open_ = merged[-1].weight < MIN
    out: list[Chunk] = []
    for s in merged:
        def emit(piece, lang="", s=s):
            if piece:
                out.append(Chunk(piece[0].start, piece[-1].end, s.path, s.level, lang))

        if s.weight <= MAX and not any(b.fence and b.weight > TARGET for b in s.blocks):
            emit(s.blocks)
            continue
        piece: list[Block] = []
        for b in s.blocks:
            size = sum(x.weight for x in piece)
            if b.fence and b.weight > TARGET:
                emit(piece)
                emit([b], b.lang)
                piece = []
                continue
            if size and size + b.weight > MAX:
                emit(piece)
                piece = []
            piece.append(b)
            if sum(x.weight for x in piece) >= TARGET:
                emit(piece)
                piece = []
        emit(piece)
    title = meta.get("title") if meta else None
    return Chunks(out, title if isinstance(title, str) else "", json.dumps(meta, default=str, sort_keys=True) if meta else None)


_go_top = re.compile(rb"^(?:func|type|const|var|import|package)\b", re.M)
_go_func = re.compile(rb"func\s*(?:\(\s*\w*\s*\*?\s*(\w+)[^)]*\)\s*)?(\w+)")
#: Of a group, its first spec names it.
_go_name = re.compile(rb"(?:type|const|var)\s*(?:\((?:\s|//[^\n]*\n|/\*.*?\*/)*)?(\w+)", re.S)


#: Keywords and signs after which a line break ends a statement; names, numbers, strings and closing brackets do too.
_go_ends = re.compile(rb"(?:[\w)\]}\"'`;]|\+\+|--)$")


#: What a string holds up to its end, by its quote; what a name or number goes on with.
_go_strings = {b'"': re.compile(rb'(?:[^"\\]+|\\.)*+', re.S), b"'": re.compile(rb"(?:[^'\\]+|\\.)*+", re.S), b"`": re.compile(rb"[^`]*")}
_go_rest = re.compile(rb"\w*")


def go_scan(data: bytes) -> tuple[list[tuple[int, str]], list[tuple[int, int]]]:
    """Top-level keywords as (place, keyword), and lines that begin a statement or spec one bracket deep as (place, place of the bracket).

    Strings and comments are passed over, so brackets in them don't count. A line continues the one before unless that ends in what a line break ends a statement after.
    """
    stack, top, inner, i, fresh, last = [], [], [], 0, True, b""
    while i < len(data):
        c = data[i : i + 1]
        if c == b"\n":
            fresh = True
        elif not c.isspace() and data[i : i + 2] not in (b"//", b"/*"):
            if fresh and not stack and (m := _go_top.match(data, i)) and (i == 0 or data[i - 1 : i] == b"\n"):
                top.append((i, m[0].decode()))
            elif fresh and len(stack) == 1 and c not in (b"}", b")") and (last[-1:] in (b"{", b"(") or _go_ends.search(last)):
                inner.append((i, stack[0]))
            fresh = False
            last = (last + c)[-2:]
        if c in (b'"', b"`", b"'"):
            i = _go_strings[c].match(data, i + 1).end()
        elif data[i : i + 2] == b"//":
            end = data.find(b"\n", i)
            i = (end if end >= 0 else len(data)) - 1
        elif data[i : i + 2] == b"/*":
            end = data.find(b"*/", i + 2)
            i = (end + 2 if end >= 0 else len(data)) - 1
        elif c in (b"{", b"("):
            stack.append(i)
        elif c in (b"}", b")"):
            if not stack:
                raise ValueError("unbalanced")
            stack.pop()
        elif not fresh and (rest := _go_rest.match(data, i + 1)[0]):
            last = (last + rest[-2:])[-2:]
            i += len(rest)
        i += 1
    return top, inner


def go_pieces(data: bytes, start: int, end: int, at: int, kind: str, inner: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """An oversized declaration cut where a statement of its body (of a function) or a spec of its group begins, each piece grown to TARGET; whole if it has fewer than two."""
    own = [x for x in inner if at < x[0] < end]
    if kind == "func":
        bodies = [o for _, o in own if data[o : o + 1] == b"{"]
        cuts = [p for p, o in own if bodies and o == bodies[-1]]
    else:
        cuts = [p for p, o in own if not data[at + len(kind) : o].strip() and data[o : o + 1] == b"("]
    out, first = [], start
    for cut in cuts[1:]:
        if weight(data[first:cut]) >= TARGET:
            out.append((first, cut))
            first = cut
    return [*out, (first, end)]


def go_source(data: bytes) -> Chunks:
    """Go files: a header chunk up to the imports, then one chunk for each top-level declaration with its doc comment; small
    neighbours merge, large ones split between statements or specs, never inside one."""
    top, inner = go_scan(data)
    if not top or top[0][1] != "package":
        raise ValueError("no package clause")
    package = re.match(rb"package\s+(\w+)", data[top[0][0] :])[1].decode()
    imports = {p.rsplit("/", 1)[-1]: p for p in re.findall(r'"([^"\n]+)"', b"".join(data[a:b] for (a, k), b in zip(top, [*(s for s, _ in top[1:]), len(data)], strict=True) if k == "import").decode("utf-8", "replace"))}

    def with_comment(at: int) -> int:
        while at:
            line = data.rfind(b"\n", 0, at - 1) + 1
            if not data[line:at].lstrip().startswith(b"//"):
                return at
            at = line
        return at

    declared = [(with_comment(a), a, k) for a, k in top if k not in ("package", "import")]
    out = []
    first = declared[0][0] if declared else len(data)
    if (end := trimmed(data, 0, first)) > 0:
        out.append(Chunk(0, end, decl_kind="package_doc", package=package, scope_path=package, lang="go"))
    for (start, at, kind), nxt in zip(declared, [*(d[0] for d in declared), len(data)][1:], strict=True):
        end = trimmed(data, start, nxt)
        body = data[at:end]
        receiver, name = "", ""
        if kind == "func" and (m := _go_func.match(body)):
            receiver, name = (m[1] or b"").decode(), m[2].decode()
        elif m := _go_name.match(body):
            name = m[1].decode()
        used = sorted(p for short, p in imports.items() if re.search(rf"\b{re.escape(short)}\.".encode(), body))[:10]
        c = Chunk(start, end, lang="go", symbol=name, receiver=receiver, decl_kind="method" if receiver else kind, signature=body.split(b"{")[0].split(b"\n")[0].strip().decode("utf-8", "replace"), exported=name[:1].isupper(), package=package, scope_path=" > ".join(x for x in (package, receiver, name) if x), imports_used=used)
        before = out[-1] if out else None
        small = weight(data[start:end]) < MIN
        if before and small and before.decl_kind == c.decl_kind and before.receiver == c.receiver and weight(data[before.byte_start : end]) <= TARGET and weight(data[before.byte_start : before.byte_end]) < MIN:
            before.byte_end, before.symbol = end, before.symbol or name
            before.imports_used = sorted({*before.imports_used, *used})[:10]
        elif weight(data[start:end]) > MAX:
            for a, b in go_pieces(data, start, end, at, kind, inner):
                if (e := trimmed(data, a, b)) > a:
                    out.append(Chunk(**asdict(c) | {"byte_start": a, "byte_end": e}))
        else:
            out.append(c)
    return Chunks(out, generated=bool(re.search(paths.GENERATED.encode(), data)))


def python_source(data: bytes) -> Chunks:
    """Python files by their top-level statements, as Go files by their declarations. Ours, and only used where chunk_documents is told so."""
    tree = ast.parse(data)
    starts = [0]
    for a, _ in line_spans(data)[1:]:
        starts.append(a)
    out: list[Chunk] = []
    for node in tree.body:
        line = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        start, end = starts[line - 1], starts[node.end_lineno] if node.end_lineno < len(starts) else len(data)
        end = trimmed(data, start, end)
        named = isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
        c = Chunk(start, end, lang="py", symbol=node.name if named else "", decl_kind=("class" if isinstance(node, ast.ClassDef) else "func") if named else "module", exported=named and not node.name.startswith("_"), scope_path=node.name if named else "")
        if out and not named and out[-1].decl_kind == "module" and weight(data[out[-1].byte_start : end]) <= TARGET:
            out[-1].byte_end = end
        else:
            out.append(c)
    return Chunks(out)


CHUNKERS = {"line-window": line_window, "markdown": markdown, "go": go_source, "python": python_source}


def chunk_file(route: str, data: bytes) -> tuple[str, Chunks]:
    """The strategy that worked, and its chunks: a file that a structural chunker can't parse goes by line windows."""
    try:
        return route, CHUNKERS[route](data)
    except (ValueError, SyntaxError):
        return "line-window", line_window(data)


SCHEMA = pa.schema(
    [("path", pa.string()), ("strategy", pa.string()), ("version", pa.int32()), ("title", pa.string()), ("front_matter", pa.string()), ("generated", pa.bool_()), ("ordinal", pa.int32()), ("content", pa.string())]
    + [(c, pa.int32()) for c in ("byte_start", "byte_end", "line_start", "line_end")]
    + [("heading_path", pa.string()), ("heading_level", pa.int32())]
    + [(c, pa.string()) for c in ("lang", "symbol", "receiver", "decl_kind", "signature", "package", "scope_path")]
    + [("exported", pa.bool_()), ("imports_used", pa.list_(pa.string()))]
)
DDL = ", ".join(f"{f.name} " + {"string": "string", "int32": "int", "bool": "boolean"}.get(str(f.type), "array<string>") for f in SCHEMA)


def chunk_documents(files: DataFrame, path: str = "path", content: str = "content", python: bool = False) -> DataFrame:
    """A row for each chunk of each file that has a route, is UTF-8 and has no NUL. content: binary or string. python: Python files go by their statements, not by line windows."""
    route = paths.route(F.col(path))
    route = F.when(F.lower(path).endswith(".py"), "python").otherwise(route) if python else route
    rows = files.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("data"), route.alias("route")).where("route is not null and data is not null")

    def run(batches):
        for batch in batches:
            out: list[dict] = []
            for p, data, route in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    data.decode()
                except UnicodeDecodeError:
                    continue
                if b"\0" in data:
                    continue
                strategy, found = chunk_file(route, data)
                starts = [a for a, _ in line_spans(data)]
                for k, c in enumerate(found.chunks):
                    place = {"path": p, "strategy": strategy, "version": VERSIONS[strategy], "title": found.title, "front_matter": found.front_matter, "generated": found.generated, "ordinal": k}
                    place |= {"content": data[c.byte_start : c.byte_end].decode("utf-8", "replace"), "line_start": bisect.bisect_right(starts, c.byte_start), "line_end": bisect.bisect_right(starts, c.byte_end - 1)}
                    out.append(place | asdict(c))
            yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    return rows.mapInArrow(run, DDL)
