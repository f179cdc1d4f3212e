"""A scanner of source code: tokens by language, and the symbols and calls that their nesting tells. No grammar library is needed."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

LINE_COMMENT, BLOCK_COMMENT = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
QUOTED = r'"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)'
SINGLE = r"'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)"
RAW_BACKTICK = r"`[^`]*(?:`|\Z)"
#: What a language skips (comments) and what it takes for one literal, in the order they are tried.
LEXICON = {
    "python": (r"\#[^\n]*|\\\n", [r'(?i:[rbfu]{0,2})(?:"""(?:\\.|[^\\])*?(?:"""|\Z)|' + r"'''(?:\\.|[^\\])*?(?:'''|\Z))", rf"(?i:[rbfu]{{0,2}}){QUOTED}", rf"(?i:[rbfu]{{0,2}}){SINGLE}"]),
    "go": (rf"{LINE_COMMENT}|{BLOCK_COMMENT}", [RAW_BACKTICK, QUOTED, SINGLE]),
    "rust": (rf"{LINE_COMMENT}|{BLOCK_COMMENT}", [r'\bb?r(?P<fence>\#*)".*?(?:"(?P=fence)|\Z)', rf"\bb?{QUOTED}".replace(r"\n", ""), r"'(?:\\[^\n]+?|[^'\\\n])'", r"'\w+"]),
    "java": (rf"{LINE_COMMENT}|{BLOCK_COMMENT}", [r'"""(?:\\.|[^\\])*?(?:"""|\Z)', QUOTED, SINGLE]),
    "cpp": (rf"{LINE_COMMENT}|{BLOCK_COMMENT}|^[ \t]*\#(?:\\\n|[^\n])*", [r'\bR"(?P<tag>[^\s(]{0,16})\(.*?(?:\)(?P=tag)"|\Z)', QUOTED, SINGLE]),
    "javascript": (rf"{LINE_COMMENT}|{BLOCK_COMMENT}", [r"`(?:\\.|[^`\\])*(?:`|\Z)", QUOTED, SINGLE, r"(?<=[=(,:!&|?;\[{}])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*"]),
}
DIALECTS = {"c": "cpp", "typescript": "javascript", "tsx": "javascript"}
PUNCTUATION = r"=>|->|::|:=|[^\s\w]"
#: Languages whose statements can end with a line.
BY_LINE = {"go", "javascript"}

SHARED = "if for while switch return do else case"
#: Words of each language that can stand before a parenthesis and name nothing.
CONTROL = {
    "cpp": {*SHARED.split(), *"catch try throw new delete sizeof static_assert decltype noexcept alignof alignas and or not using typeid co_await co_yield co_return".split()},
    "java": {*SHARED.split(), *"catch try throw new synchronized assert super this".split()},
    "go": {*SHARED.split(), *"select func go defer range type var const import interface struct map chan".split()},
    "rust": {*SHARED.split(), *"match loop fn pub mod use unsafe move as in impl where crate mut ref".split()},
    "javascript": {*SHARED.split(), *"catch try throw new typeof delete await yield function async import super in of void instanceof with".split()},
    "python": {*SHARED.split(), *"elif try except with as assert del not and or in is lambda raise yield await def class import from match".split()},
}


class Token(NamedTuple):
    text: str
    line: int
    #: w(ord), l(iteral), p(unctuation) or n(ew line)
    kind: str


class Symbol(NamedTuple):
    name: str
    kind: str
    start_line: int
    end_line: int


class Call(NamedTuple):
    line: int
    receiver: str | None
    callee: str


def tokenizer(language: str) -> re.Pattern:
    skipped, literals = LEXICON[DIALECTS.get(language, language)]
    return re.compile(rf"(?P<skip>{skipped})|(?P<l>{'|'.join(literals)})|(?P<w>[^\W\d][\w$]*|\$[\w$]*)|(?P<d>\d[\w.]*)|(?P<n>\n)|(?P<p>{PUNCTUATION})", re.S | re.M)


PATTERNS = {language: tokenizer(language) for language in [*LEXICON, *DIALECTS]}


def tokens_of(text: str, language: str) -> list[Token]:
    """The tokens of a text, comments left out."""
    out, line = [], 1
    for m in PATTERNS[language].finditer(text):
        kind, found = m.lastgroup, m.group()
        if m["skip"] is None:
            kind = "l" if m["l"] is not None else "w" if m["w"] is not None else "l" if m["d"] is not None else "n" if m["n"] is not None else "p"
            out.append(Token(found.strip() if kind == "l" else found, line, kind))
        line += found.count("\n")
    return out


@dataclass
class Frame:
    """An open bracket: what encloses it, the statement that is being read within it, and the symbol whose body it is."""

    bracket: str
    within: str
    head: list[Token] = field(default_factory=list)
    symbol: tuple[str, str, int] | None = None


GROUPS = {")": "(", "]": "[", "}": "{"}


def words(head: list[Token]) -> list[str]:
    return [t.text for t in head if t.kind == "w"]


def name_before_group(head: list[Token], family: str) -> Token | None:
    """The word in front of the first parenthesised group, unless a statement of its own begins there."""
    for at, t in enumerate(head):
        if t.text == "()" and at and head[at - 1].kind == "w" and head[at - 1].text not in CONTROL[family]:
            return head[at - 1]
        if t.text in ("=", "()"):
            return None
    return None


def after_word(head: list[Token], *known: str) -> tuple[Token, Token] | None:
    """The first of the known words that another word follows, and that word."""
    for at, t in enumerate(head[:-1]):
        if t.kind == "w" and t.text in known:
            rest = [x for x in head[at + 1 :] if x.text != "*"]
            if rest and rest[0].kind == "w":
                return t, rest[0]
    return None


def of_cpp(head: list[Token], within: str) -> tuple[str, str, int] | None:
    kinds = {"namespace": "namespace", "class": "class", "struct": "struct", "union": "struct", "enum": "enum"}
    while head and (head[0].text in ("template", "<>", "public", "private", "protected", ":", "[]", "extern", "export") or head[0].kind == "l"):
        head = head[1:]
    texts = [t.text for t in head]
    until = next((i for i, t in enumerate(texts) if t in (":", "final", "()", "=")), len(texts))
    if any(t in kinds for t in texts[:until]):
        first = next(i for i, t in enumerate(texts) if t in kinds)
        named = [t.text for t in head[first + 1 : until] if t.kind == "w" and t.text not in kinds and t.text != "alignas"]
        return ("::".join(named) if texts[first] == "namespace" else named[-1], kinds[texts[first]], head[0].line) if named else None
    if within == "function":
        return None
    if "operator" in texts:
        at = texts.index("operator")
        return "operator" + "".join("()" if t == "()" else t for t in texts[at + 1 : at + 2]), "function", head[0].line
    named = name_before_group(head, "cpp")
    if named is None:
        return None
    at = head.index(named)
    return ("~" if at and texts[at - 1] == "~" else "") + named.text, "function", head[0].line


def of_java(head: list[Token], within: str) -> tuple[str, str, int] | None:
    texts = words(head)
    while head and head[0].text == "@":
        head = head[3 if len(head) > 2 and head[2].text == "()" else 2 :]
    named = after_word(head, "class", "interface")
    if named and "new" not in texts:
        return named[1].text, "class", head[0].line
    method = name_before_group(head, "java")
    before = head[head.index(method) - 1].text if method and head.index(method) else ""
    if within != "class" or method is None or "new" in texts or before in (".", "@"):
        return None
    return method.text, "constructor" if before in ("", "public", "private", "protected") else "method", head[0].line


def of_go(head: list[Token], within: str) -> tuple[str, str, int] | None:
    texts = [t.text for t in head]
    if texts[:1] == ["func"] and len(head) > 2:
        if head[1].kind == "w":
            return head[1].text, "function", head[0].line
        if texts[1] == "()" and head[2].kind == "w":
            return head[2].text, "method", head[0].line
    if texts[:1] == ["type"] and len(head) > 2 and head[1].kind == "w":
        return head[1].text, "struct", head[0].line
    if within == "types" and head and head[0].kind == "w":
        return head[0].text, "struct", head[0].line
    return None


def of_rust(head: list[Token], within: str) -> tuple[str, str, int] | None:
    kinds = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "class", "mod": "namespace"}
    while head and head[0].text in ("#", "!", "[]"):
        head = head[1:]
    named = after_word(head, *kinds)
    return (named[1].text, kinds[named[0].text], head[0].line) if named and "impl" not in [t.text for t in head[: head.index(named[0])]] else None


def of_javascript(head: list[Token], within: str) -> tuple[str, str, int] | None:
    texts = [t.text for t in head]
    if "=>" in texts:
        for at in range(texts.index("=>"), 1, -1):
            if texts[at] == "=" and texts[0] in ("const", "let", "var", "export"):
                first = next((t for t in head if t.kind == "w" and t.text not in ("export", "const", "let", "var")), None)
                return (first.text, "function", first.line) if first and at - head.index(first) <= 1 + texts[:at].count(":") * at else None
        return None
    if "=" not in texts and "new" not in texts:
        for word, kind in (("class", "class"), ("interface", "class"), ("function", "function")):
            if word in texts and texts.index(word) + 1 < len(head):
                named = head[texts.index(word) + 1]
                if named.kind == "w" and named.text not in ("extends", "implements") and all(t in ("export", "default", "declare", "abstract", "async") for t in texts[: texts.index(word)]):
                    return named.text, kind, head[texts.index(word)].line
                return None
        method = name_before_group(head, "javascript")
        if within in ("class", "object") and method is not None and texts[0] not in CONTROL["javascript"] - {"async"} and all(t.kind == "w" or t.text in ("*", "#", "@", "()") for t in head[: head.index(method)]):
            return method.text, "method", method.line
    return None


HEADS = {"cpp": of_cpp, "c": of_cpp, "java": of_java, "go": of_go, "rust": of_rust, "javascript": of_javascript, "typescript": of_javascript, "tsx": of_javascript}
#: What a statement can end with before a line's end, where lines end statements.
CLOSED = re.compile(r"[\w\"'`)\]}$]$")


def whole_statement(head: list[Token], language: str, within: str) -> tuple[str, str, int] | None:
    """The symbol of a statement that has no body in braces."""
    texts = [t.text for t in head]
    family = DIALECTS.get(language, language)
    if family == "go" and (texts[:1] == ["type"] or within == "types"):
        return of_go(head, within) if len(head) > 1 else None
    if family == "rust" and after_word(head, "struct", "mod") and "=" not in texts:
        return of_rust(head, within)
    if family == "javascript" and "=>" in texts:
        return of_javascript(head, within)
    if family == "java" and within == "class" and texts[-1:] == ["()"] and "=" not in texts:
        return of_java(head, within)
    return None


def braced_symbols(tokens: list[Token], language: str) -> list[Symbol]:
    family, head_of = DIALECTS.get(language, language), HEADS[language]
    found: list[Symbol] = []
    frames = [Frame("", "top")]
    open_ = dict.fromkeys("([{<", 0)
    last = 1

    def finish(frame: Frame) -> None:
        if frame.head and frame.bracket in ("", "{") or frame.within == "types":
            own = whole_statement(frame.head, language, frame.within)
            if own:
                found.append(Symbol(*own, last))
        frame.head = []

    for at, t in enumerate(tokens):
        frame = frames[-1]
        if t.kind == "n":
            behind = next((x for x in tokens[at + 1 : at + 4] if x.kind != "n"), None)
            goes_on = behind is not None and family != "go" and behind.kind == "p" and behind.text not in "@#"
            if family in BY_LINE and frame.bracket in ("", "{") + (("(",) if frame.within == "types" else ()) and frame.head and CLOSED.search(frame.head[-1].text) and not goes_on:
                finish(frame)
            continue
        if t.kind == "p" and t.text in "([{":
            symbol, within = None, frame.within
            if t.text == "{":
                symbol = head_of(frame.head, frame.within) if frame.bracket in ("", "{") or family == "javascript" or frame.within == "types" else None
                texts = [x.text for x in frame.head]
                within = {"class": "class", "struct": "class", "enum": "class", "namespace": "top", "function": "function", "method": "function", "constructor": "function"}[symbol[1]] if symbol else within
                if symbol is None and family == "javascript":
                    within = "object" if not texts or texts[-1] in ("=", "()", "return", ",", ":", "default", "?") and texts[-1] != "()" else "function" if within == "object" else within
                if symbol is None and family == "java" and "new" in texts:
                    within = "class"
                if symbol is None and family == "java" and after_word(frame.head, "enum", "record"):
                    within = "class"
                if symbol is None and family == "rust" and "impl" in texts:
                    within = "class"
            elif t.text == "(" and family == "go" and [x.text for x in frame.head] == ["type"]:
                within = "types"
            frames.append(Frame(t.text, within, symbol=symbol))
            open_[t.text] += 1
        elif t.kind == "p" and t.text in ")]}":
            if not open_[GROUPS[t.text]]:
                frame.head = []
            else:
                while True:
                    closed = frames.pop()
                    open_[closed.bracket] -= 1
                    if closed.bracket == "{" or closed.within == "types":
                        finish(closed)
                    if closed.symbol:
                        found.append(Symbol(*closed.symbol, t.line))
                    if closed.bracket == GROUPS[t.text]:
                        break
                outer = frames[-1]
                ended = t.text == "}" and (closed.symbol is not None or family not in BY_LINE and not any(x.text == "=" for x in outer.head) or bool(outer.head) and outer.head[0].text in CONTROL[family])
                if ended:
                    outer.head = []
                elif outer.head or t.text != "}":
                    outer.head.append(Token({")": "()", "]": "[]", "}": "{}"}[t.text], t.line, "p"))
        elif t.text == ";" and t.kind == "p":
            finish(frame)
        elif t.text == "," and (frame.bracket in ("(", "[") or frame.within == "object" or frame.head and frame.head[-1].text == "{}"):
            # a list's elements are statements of their own, however long it is
            frame.head = []
        elif t.text == "<" and family == "cpp" and frame.head and frame.head[-1].text == "template":
            frames.append(Frame("<", "template"))
            open_["<"] += 1
        elif t.text == ">" and frame.bracket == "<":
            frames.pop()
            open_["<"] -= 1
            frames[-1].head.append(Token("<>", t.line, "p"))
        elif t.text == ":" and family == "cpp" and len(frame.head) == 1 and frame.head[0].text in ("public", "private", "protected"):
            frame.head = []
        else:
            frame.head.append(t)
        last = t.line
    while frames:
        closed = frames.pop()
        if closed.bracket != "(":
            finish(closed)
        if closed.symbol:
            found.append(Symbol(*closed.symbol, last))
    return found


def python_symbols(tokens: list[Token], text: str) -> list[Symbol]:
    """def and class by indentation: a block ends with its last line that stands deeper than its head."""
    indents = [len(line) - len(line.lstrip()) for line in text.expandtabs(8).split("\n")]
    found: list[Symbol] = []
    open_: list[tuple[int, str, str, int]] = []
    depth, last, begins = 0, 1, True
    for at, t in enumerate(tokens):
        if t.kind == "n":
            begins = begins or depth == 0
            continue
        if begins and depth == 0:
            while open_ and indents[t.line - 1] <= open_[-1][0]:
                found.append(Symbol(*open_.pop()[1:], last))
            line = [x for x in tokens[at : at + 3] if x.kind == "w"]
            if line and line[0].text == "async":
                line = line[1:]
            if len(line) > 1 and line[0].text in ("def", "class") and line[0].line == t.line:
                open_.append((indents[t.line - 1], line[1].text, "class" if line[0].text == "class" else "function", t.line))
        begins = False
        depth = max(0, depth + (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}"))) if t.kind == "p" else depth
        # a def on the same line as its class's head or behind a semicolon isn't told
        last = t.line + t.text.count("\n")
    while open_:
        found.append(Symbol(*open_.pop()[1:], last))
    return found


def declarations(text: str, language: str, tokens: list[Token]) -> list[Symbol]:
    return python_symbols(tokens, text) if language == "python" else braced_symbols(tokens, language)


def symbols_of(text: str | None, language: str | None) -> list[Symbol]:
    """Functions, methods and types of a text, each (name, first and last line) once, in order of first line; none of a language that isn't known.

    Constructors of Java aren't symbols; for a namespace of several names they are joined.
    """
    if language not in PATTERNS or not text:
        return []
    once = {(s.name, s.start_line, s.end_line): s for s in reversed(declarations(text, language, tokens_of(text, language))) if s.kind != "constructor"}
    return sorted(once.values(), key=lambda s: (s.start_line, -s.end_line, s.name))


def calls_of(text: str | None, language: str | None) -> list[Call]:
    """Calls outside comments and strings: a word before a parenthesis that isn't a keyword, the name of what is being declared, or that of what is made
    by new; with the word in front of it if it is a member."""
    if language not in PATTERNS or not text:
        return []
    family = DIALECTS.get(language, language)
    every = tokens_of(text, language)
    tokens = [t for t in every if t.kind != "n"]
    declared = {(s.name.removeprefix("~"), s.start_line) for s in declarations(text, language, every)}
    out = []
    for at, t in enumerate(tokens[:-1]):
        if t.kind != "w" or tokens[at + 1].text != "(" or t.text in CONTROL[family]:
            continue
        before = tokens[at - 1].text if at else ""
        member = before in (".", "->", "?.") and at > 1
        if before in ("def", "class", "func", "fn", "function", "new", "@") or not member and (t.text, t.line) in declared:
            continue
        out.append(Call(t.line, tokens[at - 2].text if member and tokens[at - 2].kind == "w" else None, t.text))
    return out
