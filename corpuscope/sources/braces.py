"""Definitions in languages whose blocks are braces or end with ``end``: headers by pattern, extents by matching blocks.

Comments and strings are blanked first, so that what they hold neither opens a block nor looks like a header.
"""

from __future__ import annotations

import re
from bisect import bisect_right

_MODS = r"(?:(?:pub(?:\([\w\s:]+\))?|public|private|protected|internal|static|export|default|abstract|final|async|unsafe|open|sealed|data|override|inline|virtual|extern|const|constexpr|declare|partial|readonly|implicit|lazy|case|suspend|operator|mutating|fileprivate|synchronized|native|explicit|friend)\s+)*"
_NAME = r"[A-Za-z_$][\w$]*"
_C_CALL = rf"{_MODS}(?:template\s*<[^;{{]*?>\s*)?(?:[\w:<>,*&\[\]?.~]+[\s*&]+)+?(?P<name>(?:{_NAME}::)*~?{_NAME})\s*\([^;{{}}]*\)[^;{{}}=]*"

#: Headers by language: (kind, pattern with a name, whether definitions inside belong to it). A header is followed by its block.
HEADERS = {
    "go": [("function", rf"func\s+(?P<name>{_NAME})\s*(?:\[[^\]]*\])?\(", False), ("method", rf"func\s+\(\s*\w*\s*\*?(?P<owner>{_NAME})(?:\[[^\]]*\])?\s*\)\s*(?P<name>{_NAME})\(", False), ("class", rf"type\s+(?P<name>{_NAME})(?:\[[^\]]*\])?\s+(?:struct|interface)\b", True)],
    "java": [("class", rf"{_MODS}(?:class|interface|enum|record|@interface)\s+(?P<name>{_NAME})", True), ("function", rf"{_MODS}(?:<[^>{{;]*>\s*)?(?:[\w<>\[\],.?]+\s+)?(?P<name>{_NAME})\s*\([^;{{}}]*\)(?:\s*throws\s+[\w,.\s]+)?", False)],
    "csharp": [("class", rf"{_MODS}(?:class|interface|struct|enum|record(?:\s+struct)?)\s+(?P<name>{_NAME})", True), ("namespace", rf"namespace\s+(?P<name>[\w.]+)", None), ("function", rf"{_MODS}(?:[\w<>\[\],.?]+\s+)?(?P<name>{_NAME})\s*(?:<[^>]*>)?\([^;{{}}]*\)[^;{{}}=]*", False)],
    "rust": [("function", rf"{_MODS}(?:extern\s*)?fn\s+(?P<name>{_NAME})", False), ("class", rf"{_MODS}(?:struct|enum|union|trait)\s+(?P<name>{_NAME})", True), ("impl", rf"(?:unsafe\s+)?impl(?:\s*<[^{{;]*?>)?\s+(?:[\w:<>,'&\s]+?\s+for\s+)?(?P<name>{_NAME})", True), ("module", rf"{_MODS}mod\s+(?P<name>{_NAME})", None)],
    "cpp": [("class", rf"(?:template\s*<[^;{{]*?>\s*)?(?:typedef\s+)?(?:class|struct|union|enum(?:\s+class)?)\s+(?:\[\[\w+\]\]\s*)?(?P<name>{_NAME})[^;(){{}}=]*", True), ("namespace", rf"namespace\s+(?P<name>[\w:]+)", None), ("function", _C_CALL, False), ("function", rf"(?P<name>(?:{_NAME}::)+~?{_NAME})\s*\([^;{{}}]*\)[^;{{}}]*", False)],
    "javascript": [("function", rf"{_MODS}function\s*\*?\s*(?P<name>{_NAME})\s*\(", False), ("class", rf"{_MODS}class\s+(?P<name>{_NAME})", True), ("function", rf"{_MODS}(?:const|let|var)\s+(?P<name>{_NAME})\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:function\b|\([^;{{}}]*\)\s*(?::[^=;{{}}]+)?=>|{_NAME}\s*=>)", False), ("method", rf"(?:(?:static|async|get|set|public|private|protected|readonly|override|abstract)\s+)*[*#]?(?P<name>{_NAME})\s*(?:<[^>]*>)?\([^;{{}}]*\)(?:\s*:\s*[^;{{}}]+)?", False)],
    "kotlin": [("class", rf"{_MODS}(?:enum\s+|annotation\s+)?(?:class|interface|object)\s+(?P<name>{_NAME})", True), ("function", rf"{_MODS}fun\s+(?:<[^>]*>\s*)?(?:[\w<>.?]+\.)?(?P<name>{_NAME})\s*\(", False)],
    "scala": [("class", rf"{_MODS}(?:class|trait|object|enum)\s+(?P<name>{_NAME})", True), ("function", rf"{_MODS}def\s+(?P<name>{_NAME})", False)],
    "swift": [("class", rf"{_MODS}(?:class|struct|enum|protocol|extension|actor)\s+(?P<name>{_NAME})", True), ("function", rf"{_MODS}func\s+(?P<name>{_NAME})", False), ("method", rf"{_MODS}(?P<name>init)[?!]?\s*\(", False)],
    "php": [("class", rf"{_MODS}(?:class|interface|trait|enum)\s+(?P<name>{_NAME})", True), ("function", rf"{_MODS}function\s+&?(?P<name>{_NAME})\s*\(", False)],
    "ruby": [("class", r"(?:class|module)\s+(?P<name>[A-Z][\w:]*)", True), ("function", r"def\s+(?:self\.)?(?P<name>[A-Za-z_]\w*[?!=]?)", False)],
    "lua": [("function", r"(?:local\s+)?function\s+(?P<name>[\w.:]+)\s*\(", False), ("function", r"(?:local\s+)?(?P<name>[\w.]+)\s*=\s*function\s*\(", False)],
}
HEADERS["typescript"] = [("class", rf"{_MODS}(?:interface|enum|namespace)\s+(?P<name>{_NAME})", True), *HEADERS["javascript"]]

#: Words that stand before a bracket and a block without naming a function.
CONTROL = {"if", "for", "while", "switch", "catch", "return", "else", "do", "try", "when", "using", "lock", "foreach", "fixed", "synchronized", "new", "throw", "super", "this", "sizeof", "function", "elseif"}

_HASH_COMMENTS = {"ruby", "php"}
_ENDS = {
    "ruby": (r"\b(?:class|module|def|do|begin|case)\b|(?m:^[ \t]*(?:if|unless|while|until|for)\b)|(?<=[=(,])[ \t]*(?:if|unless|case|begin)\b", r"\bend\b"),
    "lua": (r"\b(?:function|do|then|repeat)\b", r"\b(?:end|until|elseif)\b"),
}


def blanked(text: str, language: str) -> str:
    """The text with comments and strings as spaces; line breaks stay."""
    if language == "lua":
        pattern = r"--\[\[.*?\]\]|--[^\n]*|\[\[.*?\]\]|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
    elif language == "ruby":
        pattern = r"(?m:^=begin\b.*?^=end\b)|#(?!\{)[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'"
    else:
        tick = r"|`(?:\\.|[^`\\])*`" if language in ("javascript", "typescript", "go") else ""
        char = r"'(?:\\[^\n]{1,10}?|[^'\\\n])'" if language in ("rust", "java", "csharp", "cpp", "kotlin", "scala", "go", "swift") else r"'(?:\\.|[^'\\\n])*'"
        block = r"\"\"\".*?\"\"\"|" if language in ("kotlin", "scala", "swift", "java") else ""
        sharp = r"|#(?!\[)[^\n]*" if language in _HASH_COMMENTS else ""
        pattern = rf"/\*.*?\*/|//[^\n]*{sharp}|{block}\"(?:\\.|[^\"\\\n])*\"|{char}{tick}"
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def _blocks(plain: str, language: str) -> dict[int, int]:
    """Where each block that begins at a place ends."""
    if language in _ENDS:
        opening, closing = _ENDS[language]
        marks = sorted([(m.start(), 1, m.end()) for m in re.finditer(opening, plain)] + [(m.start(), 0, m.end()) for m in re.finditer(closing, plain)])
    else:
        marks = [(m.start(), int(m[0] == "{"), m.end()) for m in re.finditer(r"[{}]", plain)]
    out, stack = {}, []
    for at, opens, end in marks:
        if opens:
            stack.append(at)
        elif stack:
            out[stack.pop()] = end - 1
    return out


def definitions(text: str, language: str) -> list[tuple[str, str, int, int]]:
    """(kind, qualified name, first line, last line), lines from 0, of a file's definitions; methods carry their owner's name.

    A header without a block of its own (a prototype) is none. An unfinished block reaches to the end of the text.
    """
    plain = blanked(text, language)
    ends, starts = _blocks(plain, language), [m.end() for m in re.finditer("\n", plain)]
    line = lambda at: bisect_right(starts, at)
    own_blocks = language in _ENDS
    found: dict[int, tuple] = {}
    for kind, pattern, inner in HEADERS[language]:
        for m in re.compile(rf"(?m:^[ \t]*)(?P<head>{pattern})").finditer(plain):
            head, name = m.start("head"), m["name"]
            if name in CONTROL or head in found or re.match(r"(?:return|else|throw|new|await|yield|typedef)\b(?!.*\b(?:class|struct)\b)", plain[head : m.end()]):
                continue
            if own_blocks:
                opened = next((k for k in ends if head <= k <= m.end()), None)
                block = opened if opened is not None else head
                end = ends.get(block, len(plain) - 1)
            else:
                brace, stop = plain.find("{", m.end() - 1), plain.find(";", m.end())
                if language in ("kotlin", "scala", "swift", "javascript", "typescript"):
                    eol = plain.find("\n", m.end())
                    after = plain[m.end() : brace] if brace >= 0 else plain[m.end() :]
                    if brace < 0 or (0 <= stop < brace) or (0 <= eol < brace and re.search(r"\n[ \t]*\n|\n[ \t]*(?:def|fun|func|class|object|trait|val|var|let|const|function)\b", after)):
                        if kind == "method" or (kind == "function" and language in ("swift",)):
                            continue
                        brace, end = -1, (eol if eol >= 0 else len(plain)) - 1  # a definition of one line
                elif brace < 0 or 0 <= stop < brace:
                    continue
                if brace >= 0:
                    end = ends.get(brace, len(plain) - 1)
                block = brace if brace >= 0 else head
            found[head] = (kind, name, m.groupdict().get("owner"), inner, head, max(head, end), block)
    out, open_ = [], []
    for kind, name, owner, inner, head, end, _ in sorted(found.values(), key=lambda x: (x[4], -x[5])):
        while open_ and open_[-1][1] < head:
            open_.pop()
        if any(i is False for _, _, i in open_):
            continue  # inside a function
        prefix = "".join(f"{n}." for n, _, i in open_ if i)
        if owner:
            kind, prefix = "method", f"{owner}."
        elif kind in ("function", "method") and prefix:
            kind = "method"
        elif kind == "method":
            continue  # a call and a block outside any class
        qualified = prefix + name.replace("::", ".").replace(":", ".")
        if "." in qualified and kind == "function" and language in ("cpp", "lua"):
            kind = "method"
        open_.append((name, end, inner))
        if inner is not None:
            out.append(("class" if kind in ("impl", "module") else kind, qualified, line(head), line(end)))
    return out
