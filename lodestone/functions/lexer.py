"""Strings and comments of program text, found in one pass from a table for each language.

``blanked`` gives the text with what strings and comments hold replaced by spaces, line breaks kept, so that places, lines and columns stay the same and
braces, keywords and names that are left are code. Each character is passed once, whatever nests: block comments in each
other (Rust), code in template strings (JavaScript), raw strings with any number of ``#`` (Rust).
"""

from __future__ import annotations

import re

# fixed values: what opens a string or comment, what ends it, whether a backslash escapes, whether a line's end ends it too
_C = (("//", "\n", False, False), ("/*", "*/", False, False), ('"', '"', True, True))
OPENINGS = {
    "rust": (("//", "\n", False, False), ("/*", "*/", False, False), ('"', '"', True, False)),
    "javascript": (*_C, ("'", "'", True, True), ("`", "`", True, False)),
    "java": (*_C, ('"""', '"""', True, False), ("'", "'", True, True)),
    "go": (*_C, ("'", "'", True, True), ("`", "`", False, False)),
    "python": (("#", "\n", False, False), ('"""', '"""', True, False), ("'''", "'''", True, False), ('"', '"', True, True), ("'", "'", True, True)),
}
OPENINGS["typescript"] = OPENINGS["javascript"]
OPENINGS["c"] = OPENINGS["cpp"] = OPENINGS["csharp"] = (*_C, ("'", "'", True, True))
NESTING = {"rust": "/*"}  # comments that hold others
CODE_INSIDE = {"javascript": ("`", "${"), "typescript": ("`", "${")}
_RAW = r"b?r(#*)\""
_CHARACTER = r"b?'(?:\\(?:u\{[0-9a-fA-F_]*\}|x[0-9a-fA-F]{2}|.)|[^'\\\n])'"  # else the quote begins a lifetime


def _starts(language: str) -> re.Pattern:
    own = sorted((o[0] for o in OPENINGS[language]), key=len, reverse=True)
    named = "|".join(map(re.escape, own))
    parts = [rf"(?P<open>{named})"]
    if language == "rust":
        parts = [rf"(?P<raw>(?<![A-Za-z0-9_]){_RAW})", rf"(?P<char>{_CHARACTER})", *parts]
    if language in CODE_INSIDE:
        parts += [r"(?P<brace>[{}])"]
    return re.compile("|".join(parts), re.DOTALL)


_START = {language: _starts(language) for language in OPENINGS}


def _closing(language: str, opening: str) -> re.Pattern:
    _, end, escapes, by_line = next(o for o in OPENINGS[language] if o[0] == opening)
    parts = [r"(?P<skip>\\.)"] if escapes else []
    if NESTING.get(language) == opening:
        parts.append(rf"(?P<deeper>{re.escape(opening)})")
    if opening == CODE_INSIDE.get(language, ("",))[0]:
        parts.append(rf"(?P<code>{re.escape(CODE_INSIDE[language][1])})")
    parts.append(rf"(?P<end>{re.escape(end)}" + (r"|(?=\n))" if by_line else ")"))
    return re.compile("|".join(parts), re.DOTALL)


_CLOSE = {(language, o[0]): _closing(language, o[0]) for language, some in OPENINGS.items() for o in some}
_SIGN = re.compile(r"[^\n]")


def spans(code: str, language: str) -> list[tuple[int, int]]:
    """From and to of what strings and comments hold, without their delimiters (a line comment's end is its line's); those that
    do not end reach to the end of the text. A language without a table has none."""
    out: list[tuple[int, int]] = []
    if language not in OPENINGS:
        return out
    start, at, depths = _START[language], 0, []  # depths: of braces in each code that a template string holds

    def inside(opening: str, begin: int) -> int:
        """Passes what began; a place after its end, or after where code begins in it."""
        now, level, close = begin, 1, _CLOSE[language, opening]
        while True:
            m = close.search(code, now)
            if m is None:
                out.append((begin, len(code)))
                return len(code)
            now = m.end()
            kind = m.lastgroup
            if kind == "deeper":
                level += 1
            elif kind == "code":
                out.append((begin, m.start()))
                depths.append(0)
                return now
            elif kind == "end":
                level -= 1
                if not level:
                    out.append((begin, m.start()))
                    return now if m.end() > m.start() and code[m.start()] != "\n" else m.start()

    while (m := start.search(code, at)) is not None:
        kind, at = m.lastgroup, m.end()
        if kind == "open":
            at = inside(m["open"], at)
        elif kind == "raw" or (language == "rust" and m.group(0).endswith('"') and m["raw"]):
            end = code.find('"' + m[2], at)
            out.append((at, len(code) if end < 0 else end))
            at = len(code) if end < 0 else end + 1 + len(m[2])
        elif kind == "char":
            out.append((m.start() + m.group(0).index("'") + 1, at - 1))
        elif depths:
            if m["brace"] == "{":
                depths[-1] += 1
            elif depths[-1]:
                depths[-1] -= 1
            else:
                depths.pop()
                at = inside(CODE_INSIDE[language][0], at)
    return out


def blanked(code: str, language: str) -> str:
    out, last = [], 0
    for a, b in spans(code, language):
        out += [code[last:a], _SIGN.sub(" ", code[a:b])]
        last = b
    return "".join(out) + code[last:]
