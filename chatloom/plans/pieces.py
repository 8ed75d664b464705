"""Texts made of known pieces, one of several forms a document: SQL for the text, and for where the pieces of each role stand.

A piece is SQL of a string with a role (0 for none); wide() gives a role to several pieces as a whole. Both dialects read the SQL."""

from __future__ import annotations

from dataclasses import dataclass

from chatloom.operators.calls import CLOSE, OPEN

#: A document's whole text without what would need an escape; in both dialects.
SAFE, DUCK_SAFE = "regexp_replace(text, '[^A-Za-z0-9 .,]', '_')", "regexp_replace(text, '[^A-Za-z0-9 .,]', '_', 'g')"
NAME = "CASE doc_id % 5 WHEN 0 THEN 'bash' WHEN 1 THEN 'read' WHEN 2 THEN 'shell' WHEN 3 THEN 'grep' ELSE 'lsp' END"


@dataclass
class Wide:
    role: int
    parts: tuple


Part = tuple[str, int] | Wide


def wide(role: int, *parts: Part) -> Wide:
    return Wide(role, parts)


def text(words: str) -> Part:
    return "'" + words.replace("'", "''").replace("\n", "' || chr(10) || '") + "'", 0


def marks(found: str, which: str) -> list[Part]:
    """Plain text whose characters among `which` are delimiters."""
    out, plain = [], ""
    for c in found:
        if c in which:
            out += [text(plain)] * bool(plain) + [(text(c)[0], 1)]
            plain = ""
        else:
            plain += c
    return out + [text(plain)] * bool(plain)


def flat(parts: list[Part], at: int = 0) -> tuple[list[str], list[tuple[int, int, int]]]:
    """The pieces' SQL, and for each span the number of pieces before it, up to its end, and its role."""
    pieces, spans = [], []
    for part in parts:
        begin = at + len(pieces)
        if isinstance(part, Wide):
            inner, found = flat(list(part.parts), begin)
            pieces, spans = pieces + inner, [*spans, *found, (begin, begin + len(inner), part.role)]
        else:
            pieces.append(part[0])
            spans += [(begin, begin + 1, part[1])] * bool(part[1])
    return pieces, spans


def by_form(options: list[str], other: str) -> str:
    return f"CASE doc_id % {len(options)} " + " ".join(f"WHEN {k} THEN {o}" for k, o in enumerate(options)) + f" ELSE {other} END"


def text_sql(forms: list[list[Part]]) -> str:
    return by_form([" || ".join(flat(form)[0]) for form in forms], "''")


def spans_sql(forms: list[list[Part]], rows: str = "documents") -> str:
    """For DuckDB: doc_id, start, stop, role of every span."""
    flats = [flat(form) for form in forms]
    lengths = by_form(["[" + ", ".join(f"length({p})" for p in pieces) + "]" for pieces, _ in flats], "[]")
    spans = by_form(["[" + ", ".join(f"{{'i': {i}, 'j': {j}, 'role': {r}}}" for i, j, r in sorted(set(spans))) + "]" if spans else "[]::STRUCT(i INT, j INT, role INT)[]" for _, spans in flats], "[]")
    return f"""SELECT doc_id, coalesce(list_sum(l[1:s.i]), 0)::BIGINT AS start, list_sum(l[1:s.j])::BIGINT AS stop, s.role AS role
  FROM (SELECT doc_id, {lengths} AS l, unnest({spans}) AS s FROM {rows})"""


# The forms: native blocks, prose, code.

NATIVE, CODE = "[](),=", "=(),[]{}:."
V, N = ("'''' || {safe} || ''''", 4), ("n_chars || ''", 4)
#: The call that most forms hold.
CALL = [(NAME, 2), ("'('", 1), ("'command'", 3), ("'='", 1), V, *marks(", ", NATIVE), ("'n'", 3), ("'='", 1), N, *marks(", ", NATIVE), ("'flag'", 3), ("'='", 1), ("'True'", 4), *marks(", ", NATIVE), ("'word'", 3), ("'='", 1), ("'quiet'", 4), ("')'", 1)]


def block(*parts: Part) -> list[Part]:
    return [text("lead "), (text(OPEN)[0], 1), *parts, (text(CLOSE)[0], 5), (text("<|im_end|>")[0], 5)]


def short(name: str, key: str, value: Part, which: str = NATIVE) -> list[Part]:
    return [(text(name)[0], 2), *marks("(", which), (text(key)[0], 3), *marks("=", which), value, *marks(")", which)]


LB, RB, COMMA = marks("[", NATIVE), marks("]", NATIVE), marks(", ", NATIVE)
FORMS: list[list[Part]] = [
    block(*LB, *CALL, *RB),
    block(*LB, *CALL, *COMMA, text("next.step"), *marks("(", NATIVE), ("'x'", 3), *marks("=", NATIVE), ("'-' || n_chars", 4), *marks(")", NATIVE), *COMMA, text("7"), *RB),
    block(*LB, *CALL, text(" oops"), *RB),
    [text("said "), ("{safe}", 0)],
    block(*LB, text("a + b"), *COMMA, (text("f")[0], 2), *marks("(1 + 2, x[0], ", NATIVE), ("'k'", 3), *marks("=", NATIVE), V, *marks(")", NATIVE), *RB),
    block(*LB, (text("f")[0], 2), *marks("(**{'a': 1})", NATIVE), *COMMA, *CALL, *RB),
    block(*LB, *CALL, *COMMA, *short("f", "x", (text("1 + 2")[0], 4)), *RB),
    block(*LB, ("'f'", 2), *marks("(\n ", NATIVE), ("'a'", 3), *marks("=", NATIVE), V, *marks(",\n ", NATIVE), ("'b'", 3), *marks(" = ", NATIVE), wide(4, text("g"), *marks("(", NATIVE), ("'y'", 3), *marks("=", NATIVE), N, *marks(")", NATIVE)), *marks(")", NATIVE), *RB),
    [text("import os\n"), ("'x'", 4), *marks(" = ", CODE), ("'f'", 2), *marks("(\n ", CODE), ("'a'", 3), *marks("=", CODE), ("'''é ' || {safe} || ''''", 4), *marks(",\n ", CODE), ("'b'", 3), *marks("=", CODE), N, *marks(")", CODE), text("\nif x"), *marks(":", CODE), text("\n    "),
     ("'use'", 2), *marks("(", CODE), ("'x'", 4), *marks(")[", CODE), text("0"), *marks("]", CODE), (text("<|im_end|>")[0], 5)],
    [("'y'", 4), *marks(" = ", CODE), wide(2, wide(2, text("a"), *marks(".", CODE), text("b")), *marks("(", CODE), ("'c'", 3), *marks("=", CODE), V, *marks(").", CODE), text("d")), *marks("(", CODE), ("'e'", 3), *marks("=", CODE), wide(4, *marks("[2, ", CODE), ("n_chars || ''", 0), *marks("]", CODE)), *marks(")", CODE)],
    [text("def go"), *marks("():", CODE), text("\n    return "), ("'f'", 2), *marks("(", CODE), ("'a'", 3), *marks("=", CODE), wide(4, text("1 + "), ("n_chars || ''", 0)), *marks(", ", CODE), wide(4, text("*"), ("'g'", 2), *marks("(", CODE), wide(4, ("'h'", 2), *marks("(", CODE), V, *marks(")", CODE)), *marks(")", CODE)), *marks(")", CODE)],
    [text("x = f(a="), (V[0], 0)],
]
TEXT = text_sql(FORMS)
#: What reading the forms must give, by form: the number of calls, the first one's name and arguments.
N_CALLS = by_form(["1", "2", "0", "0", "1", "2", "0", "0", "0", "0", "0", "0"], "0")
ARGUMENTS = """'{"command": "' || {safe} || '", "flag": true, "n": ' || n_chars || ', "word": "quiet"}'"""
FIRST_NAME = by_form([NAME, NAME, "NULL", "NULL", "'f'", "'f'", *["NULL"] * 6], "NULL")
FIRST_ARGUMENTS = by_form([ARGUMENTS, ARGUMENTS, "NULL", "NULL", """'{"k": "' || {safe} || '"}'""", "'{}'", *["NULL"] * 6], "NULL")


def spark_sql(e: str) -> str:
    return e.replace("{safe}", SAFE)


def duck(e: str) -> str:
    return e.replace("{safe}", DUCK_SAFE)


# Texts whose pieces in the public byte-level vocabulary are known: ASCII letters, each after a blank, are a piece each.

LETTERS = "regexp_replace(text, '[^A-Za-z]', '')"
SPACED, DUCK_LETTERS = f"regexp_replace({LETTERS}, '([A-Za-z])', ' $1')", LETTERS.replace("'')", "'', 'g')")


@dataclass
class Known:
    """Pieces before and after a document's letters, parted by ¦, with a role a piece; and the letters' role."""

    before: str
    before_roles: str
    letters: int
    after: str
    after_roles: str

    def sides(self) -> list[list[tuple[str, int]]]:
        return [list(zip(p.split("¦"), map(int, r), strict=True)) for p, r in ((self.before, self.before_roles), (self.after, self.after_roles))]


def known_text(forms: list[Known]) -> str:
    """For Spark: the text of a document's form."""
    return by_form([text(f.before.replace("¦", ""))[0] + f" || {SPACED} || " + text(f.after.replace("¦", ""))[0] for f in forms], "''")


def known_sql(forms: list[Known]) -> str:
    """For DuckDB: doc_id, n, start, role of every piece."""
    def listed(pieces: list[tuple[str, int]]) -> str:
        at, out = 0, []
        for n, (piece, role) in enumerate(pieces):
            out.append(f"{{'n': {n}, 'at': {at}, 'role': {role}}}")
            at += len(piece)
        return "[" + ", ".join(out) + "]"

    before, after = ([f.sides()[k] for f in forms] for k in (0, 1))
    count, chars = (by_form([str(x) for x in xs], "0") for xs in ([len(b) for b in before], [sum(len(p) for p, _ in b) for b in before]))
    return f"""WITH d AS (SELECT doc_id, length({DUCK_LETTERS}) AS k, {count} AS n, {chars} AS c, {by_form([listed(b) for b in before], '[]')} AS b, {by_form([listed(a) for a in after], '[]')} AS a, {by_form([str(f.letters) for f in forms], '0')} AS r FROM documents)
  SELECT doc_id, x.n::INT AS n, x.at::BIGINT AS start, x.role AS role FROM (SELECT doc_id, unnest(b) AS x FROM d) UNION ALL SELECT doc_id, (n + i)::INT, c + 2 * i, r FROM (SELECT *, unnest(range(k)) AS i FROM d)
  UNION ALL SELECT doc_id, (n + k + x.n)::INT, c + 2 * k + x.at, x.role FROM (SELECT *, unnest(a) AS x FROM d)"""


#: Roles 1 to 5 are those of calls' spans.
ROLE_FORMS = [
    Known("lead¦ <¦|¦tool¦_¦call¦_¦start¦|¦>[¦bash¦(¦command¦='¦ x", "011111111121344", 4, "',¦ n¦=¦7¦)]¦<¦|¦tool¦_¦call¦_¦end¦|¦>", "43141" + "5" * 9),
    Known("lead¦ <¦|¦tool¦_¦call¦_¦start¦|¦>[¦read¦(¦command¦='¦ ¦中¦ x", "01111111112134444", 4, "',¦ n¦=¦7¦)]¦<¦|¦tool¦_¦call¦_¦end¦|¦>", "43141" + "5" * 9),
    Known("x¦ =¦ f¦(¦a¦='¦ x", "4121344", 4, "')¦\n¦use¦(¦x¦)", "402141"),
    Known("so¦ x", "00", 0, " it¦ is", "00"),
]
#: 1 where code marks or a fence hold a piece.
LITERAL_FORMS = [
    Known("say¦ `¦ x", "001", 1, "`¦ and¦\n¦``¦`¦py¦\n¦ x¦\n¦``¦`¦ so¦ `¦ x¦`,¦ é¦`¦ x¦\n¦`¦no", "000000011000010000000"),
    Known("``¦`¦py¦\n¦ x", "00001", 1, "\n¦``¦`¦ x", "1000"),
    Known("so¦ x", "00", 0, " `¦no", "00"),
]
