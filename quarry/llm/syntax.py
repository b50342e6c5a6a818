"""Problem 2: source files that do not parse, by language-specific lexers with a pushdown stack.

A file's text is cut into tokens by its language's lexer and every token becomes one letter of a
class string ('i' a name, 'n' a number, 's' a literal, brackets as themselves, 'E' what no rule of
the lexer can read: an unterminated literal or comment, a stray character, a merge-conflict
marker). A pushdown stack then walks the brackets of that string: it reports a bracket that
closes nothing or the wrong one and what is open at the end, and it gives each bracketed stretch
its kind (control head, call, block, literal). Patterns over the class string say which
neighbours the grammar forbids: two operands side by side, an operator without an operand, a
block header without its block. JSON needs no patterns: the stack says what may come next.

Python and JSON verdicts are confirmed by their parsers; other languages have none here.
"""

import ast
import json
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".go": "go", ".json": "json"}

_STRING = r'"(?:[^"\\\n]|\\[\s\S])*+"' + r"|'(?:[^'\\\n]|\\[\s\S])*+'"
_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/|/\*"
_MARK = r"(?<=\n)<{7}(?= |\n)[^\n]*|(?<=\n)>{7}(?= |\n)[^\n]*|(?<=\n)\|{7}(?= |\n)[^\n]*|(?<=\n)={7}(?=\n)"
_NAME = r"[^\W\d][\w$]*"
_NUMBER = r"\.?\d(?:[eEpP][+-]\d|[\w.])*"

_LEX = {
    "javascript": rf"[ \t\f\v\xa0]*((?:{_MARK})|\n|{_COMMENT}|{_STRING}|`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\$\{{(?:[^`{{}}]|`[^`]*`|\{{[^{{}}]*\}})*\}})*+`|[$#]?{_NAME}|[$][\w$]*|{_NUMBER}"
    r"|(?:[=(,:!&|?;{}\[>]|(?<![\w$.])return)[ \t]*/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*|=>|\.\.\.|\?\.(?!\d)|\+\+|--|\*\*=|\*\*|>>>=|<<=|>>=|>>>|>>|<<|===|!==|==|!=|<=|>=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|[-+*/%&|^]=|[\s\S])",
    "java": rf'[ \t\f]*((?:{_MARK})|\n|{_COMMENT}|"""[\s\S]*?(?<!\\)"""|"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\u+[0-9a-fA-F]{{4}}|\\[0-7]{{1,3}}|\\.)\'|[$]?{_NAME}|{_NUMBER}|->|::|\.\.\.|\+\+|--|>>>=|<<=|>>=|<<|==|!=|<=|>=|&&|\|\||[-+*/%&|^]=|[\s\S])',
    "go": rf"[ \t]*((?:{_MARK})|\n|{_COMMENT}|" + r'"(?:[^"\\\n]|\\.)*+"|`[^`]*`|\'(?:[^\'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.))\'' + rf"|{_NAME}|{_NUMBER}|:=|\.\.\.|<-|\+\+|--|<<=|>>=|&\^=|&\^|<<|>>|==|!=|<=|>=|&&|\|\||[-+*/%&|^]=|[\s\S])",
    "python": rf"[ \t\f]*((?:{_MARK})|\n|\\\n|#[^\n]*|(?:[rRbBuUfF]{{1,2}})?(?:\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*+'''|(?!\"\"\"|''')(?:{_STRING}))|{_NAME}|{_NUMBER}|->|:=|\*\*=|//=|<<=|>>=|\*\*|//|<<|>>|==|!=|<=|>=|[-+*/%&|^@]=|\.\.\.|[\s\S])",
}
_LEX["typescript"] = _LEX["javascript"]
_LEX = {k: re.compile(v) for k, v in _LEX.items()}

#: The keywords of each language by the part they play.
_WORDS = {
    "javascript": {
        "d": "const", "v": "let var", "f": "function", "c": "class", "r": "return", "R": "throw", "u": "typeof void delete await new yield", "o": "in instanceof",
        "O": "of", "I": "import", "X": "export", "F": "from", "A": "as", "w": "if while for switch with", "C": "catch", "Y": "finally", "t": "try", "l": "else", "L": "do",
        "a": "async static get set", "k": "break continue debugger", "K": "case default", "e": "extends", "i": "this super null true false",
    },
    "java": {
        "m": "public private protected static final abstract synchronized native transient volatile strictfp default sealed", "c": "class interface enum", "P": "package",
        "I": "import", "r": "return throw yield", "u": "new assert", "o": "instanceof", "w": "if while for switch", "C": "catch", "Y": "finally", "t": "try", "l": "else", "L": "do",
        "k": "break continue", "K": "case", "e": "extends implements throws permits", "i": "this super null true false int long double float boolean byte short char void var",
    },
    "go": {
        "P": "package", "I": "import", "f": "func", "d": "var const type", "r": "return go defer", "w": "if switch select", "W": "for", "l": "else", "k": "break continue goto fallthrough",
        "K": "case default", "h": "chan map struct interface", "g": "range", "i": "nil true false iota",
    },
    "python": {
        "f": "def class", "w": "if while for with elif except", "l": "else try finally", "r": "return raise del assert global nonlocal yield await", "o": "and or is in not lambda as",
        "I": "import", "F": "from", "k": "pass break continue", "a": "async", "i": "None True False",
    },
}
_WORDS["typescript"] = _WORDS["javascript"] | {
    "m": "interface type enum abstract declare namespace module readonly public private protected implements keyof is infer unique override satisfies asserts out",
}
_NUMBERS = re.compile(
    r"0[xX][\da-fA-F][\da-fA-F_]*[lLn]?|0[bB][01_]+[lLn]?|0[oO][0-7_]+n?|(?:0|[1-9][\d_]*|\d[\d_]*(?=[.eE])|0[0-7_]+)?(?:\.[\d_]*)?(?:[eE][+-]?\d+)?[lLfFdDnijJ]?"
)
_OPEN, _CLOSE = "([{", {")": "(", "]": "[", "}": "{"}


class _Classes(dict):
    """Token -> class letter; names are kept up to a bound, so a long run cannot fill memory."""

    def __init__(self, language: str):
        punct = {c: c for c in "()[]{};,:.?=@*<>"} | {"\n": "N", "=>": "^", "->": "^", "::": ".", "...": "D", "?.": "q", "++": "p", "--": "p", "+": "+", "-": "+", "!": "!", "~": "!", ":=": "="}
        punct |= {t: "b" for t in "/ % & | ^ ** >>> >> << === !== == != <= >= && || ??".split()} | {t: "=" for t in "+= -= *= /= %= &= |= ^= **= >>>= <<= >>= &&= ||= ??= &^= //= @=".split()}
        if language == "go":
            punct |= {"<-": "!", "&": "+", "^": "+", "&^": "b"}
        if language == "python":
            punct |= {"//": "b", "\\\n": " ", "!": "E", "?": "E", "++": "+", "--": "+", "...": "i"}
        words = {w: c for c, ws in _WORDS[language].items() for w in ws.split()}
        super().__init__({**punct, **words})
        self.language, self.fixed = language, dict(self) | {**punct, **words}

    def __missing__(self, t: str) -> str:
        c = self._of(t)
        if len(t) < 40:
            if len(self) > 100_000:
                self.clear()
                self.update(self.fixed)
            self[t] = c
        return c

    def _of(self, t: str) -> str:
        h = t[0]
        if t == "/*":
            return "E"
        if len(t) > 1 and (h == "/" and t[1] in "/*" or h == "#" and self.language == "python"):
            return "N" if "\n" in t else " "
        if h == "#" and self.language == "python":
            return " "
        if self.language == "python" and t[-1] in "\"'" and (len(t) > 2 or t[0] == t[-1] and len(t) > 1):
            return "s"
        if h in "\"'`":
            return ("T" if h == "`" else "s") if len(t) > 1 else "E"
        if len(t) > 6 and t[:7] in ("<<<<<<<", "=======", ">>>>>>>", "|||||||"):
            return "E"
        if h.isdigit() or h == "." and len(t) > 1:
            if not _NUMBERS.fullmatch(t) or len(t) > 1 and t.rstrip("0123456789") == "" and h == "0" and self.language in ("python", "javascript", "typescript") and t.strip("0"):
                return "E"
            return "n"
        if h.isalpha() or h in "_$" or h == "#" and len(t) > 1:
            return "i"
        if len(t) > 1 and t[-1].isalpha() or len(t) > 1 and "/" in t:  # an operator and the regular expression after it
            return ("r" if h == "r" else self.get(h, "=")) + "s"
        return "E"


_CLASSES: dict[str, _Classes] = {}


def _letters(text: str, language: str) -> str:
    classes = _CLASSES.get(language) or _CLASSES.setdefault(language, _Classes(language))
    return "".join([classes[t] for t in _LEX[language].findall(text)]).replace(" ", "")


_BRACKET = re.compile(r"[()\[\]{}]")


def _walk(s: str, language: str) -> tuple[str, str | None]:
    """The class string with its bracketed stretches marked, and the depth-0 string or a defect.

    Control heads become 'Z' after them instead of ')', line ends inside () and [] vanish.
    Returns (marked string, defect or None); the depth-0 string follows a NUL in the first.
    """
    out: list[str] = []
    top: list[str] = []
    stack: list[tuple[str, str]] = []  # the bracket and its kind
    at, previous, brace = 0, "", language != "python"
    for m in _BRACKET.finditer(s):
        piece, c = s[at : m.start()], m.group()
        at = m.end()
        if stack:
            if stack[-1][0] != "{" and language != "go":
                piece = piece.replace("N", "")
            if stack[-1][0] == "{" and language == "python":
                piece = piece.replace("N", "")
        else:
            top.append(piece)
        out.append(piece)
        if c in _OPEN:
            tail = piece.rstrip("N")
            before = tail[-1:] or previous
            kind = before
            if c == "(" and before and (before in "wC" or tail[-2:] == "wu" or before == "i" and _DECORATOR.search(piece)):  # wu: `for await`
                kind = "control"
            elif c == "{":
                if before == "t":
                    kind = "try"
                elif before == "m":
                    kind = "either"  # a static block, or what an annotation's element defaults to
                elif before and before in "=,([:?]r^+b&|!u" or before == "{" and stack and stack[-1][1] == "literal":
                    kind = "literal" if not (language == "java" and before == "^") else "block"
                else:
                    kind = "block"
            if not stack:
                top.append(c)
            stack.append((c, kind))
            out.append(c)
            previous = c
            continue
        if not stack or stack[-1][0] != _CLOSE[c]:
            return "", "unbalanced"
        _, kind = stack.pop()
        if not stack:
            top.append(c)
        if c == "}" and kind == "try" and brace:
            rest = s[at : at + 60].lstrip("N")
            if rest[:1] not in ("C", "Y"):
                return "", "incomplete" if not rest else "misplaced"
        if c == "}" and language == "java" and kind in ("block", "try"):
            if (piece.rstrip("N")[-1:] or previous) not in ";{}":
                return "", "misplaced"
        previous = c
        out.append("Z" if c == ")" and kind == "control" else "J" if c == "}" and kind == "literal" else c)
    if stack:
        return "", "premature end"
    out.append(s[at:])
    top.append(s[at:])
    return "".join(out) + "\0" + "".join(top), None


# A head in parentheses with a single semicolon, or with nothing in it.
_HEAD = r"w\((?:[^();{}]|\([^()]*\))*;(?:[^();{}]|\([^()]*\))*Z|w\(Z"
#: What may not stand side by side, per language, over the marked class string. Each entry: defect, pattern.
_JS = [
    ("statements not parted", r"[ns\])i][dvtRk]"),
    ("operator without operand", r"\.N*[=b:,;)\]}?]|\^N*[\^=b;,)\]}]|\?[^:?]*\Z"),
    ("declaration", r"(?:\A|;)N*(?:f\(|c\{)|XKN*(?:;|\Z)"),
    ("statement head", _HEAD + r"|(?:\A|\{)N*l(?!N*[:,}(=.])"),
    ("adjacent operands", r"[ns\])i][ins]|[Fi]Fi|F[in]|T[in]|[ns\])]T|@[^ic]"),
    ("operator without operand", r"[=b+!.?*^]N*[)\];]|[=b+!.]N*\}|[=b+!(\[]N*b|=N*=|[=b+!.,^?]N*\Z|[(=b]N*[,=]|\.N*[ns(\[{]|,N*;"),
    ("declaration", r"[dv][^iaFAO{\[N]|[dv]i[^=;,NoO)}]|di(?:[;,]|N*\Z|N+[^N=oO,;:.(\[])|f[^i(*aFA]|fi[^(]|ci[^{eN]"),
    ("statement head", r"w(?![(u:])|C[^({]|t[^{N]|[lL][)\]},=]|k[ns(\[]"),
    ("module", r"(?<!\.)I[^si{*(.aFAON]|(?<![.\w])Ii[^F,]|X[^dvfcaK{*]|F(?=[N;])(?<=[}i]F)"),
    ("object as statement", r"\AN*\{N*s:"),
    ("markup", r"(?:\A|[N;=(])N*<"),
]
_TS = [
    ("statements not parted", r"[ns\])i][dvtRk]"),
    ("operator without operand", r"\.N*[=b:,;)\]}?]|\^N*[\^=b;,)\]}]|:N*(?:=(?!\^)|\))"),
    ("declaration", r"(?:\A|;)N*(?:f\(|c\{|m\{)|XKN*(?:;|\Z)|mi:N*\}"),
    ("statement head", _HEAD + r"|(?:\A|\{)N*l(?!N*[:,}(=.])"),
    ("adjacent operands", r"[ns\])i][ns]|[n)\]s]i|(?<!m)ii|F[in]|T[in]|@[^ic]"),
    ("operator without operand", r"[=b+.*^]N*[);]|[=b+.]N*\}|[=(\[]N*b|=N*=|[=b+.,^?:]N*\Z|(?<![ns\])i])!N*\Z|\(N*,|\.N*[ns\[{]|,N*;"),
    ("declaration", r"[dv][^iaFAOm{\[N]|[dv]i[^=;,NoO)}:!]|di(?:[;,]|N*\Z)|f[^i(*aFAm<]|fi[^(<]|ci[^{eN<m]"),
    ("statement head", r"w(?![(u:])|C[^({]|t[^{N]|[lL][)\]},=]|k[ns(\[]"),
    ("module", r"(?<!\.)I[^si{*(.aFAOmN]|(?<![.\w])Ii[^F,=]|X[^dvfcaK{*mi=A]|F(?=[N;])(?<=[}i]F)"),
    ("object as statement", r"\AN*\{N*s:"),
    ("markup", r"(?:\A|[N;])N*<"),
]
_JAVA = [
    ("statement head", _HEAD + r"|\{l|e[{,;]"),
    ("adjacent operands", r"[ns][ins]|[^\[]\]i|\][ns]|i[ns]|iii|@[^ic]|(?<=[i\]>)])\([^()]*\)[ins]|s\("),
    ("operator without operand", r"[=b+!.,?^][)\];]|(?<!\.)\*[)\];]|[=b+!.][}]|[=b+!(\[][b=]|==|[(\[,],|\.[ns(\[{]|,;|[=(][<>*]"),
    ("statement head", r"w[^(]|C[^(]|t[^{(]|k[ns(]|[lL][)\],=]"),
]
_GO = [
    ("adjacent operands", r"iii|=i(?:\.i)*i"),
    ("operator without operand", r"d=|[=(]N*\[[^\[\]N]*,"),
    ("statement head", r"w[^{};Ngfd]*=[^{};Ngfd]*\{|W[^{};N]*;[^{};N]*\{|\{N*l"),
    ("adjacent operands", r"[n)\]}s][ns]|(?<!I)(?<!N)i[ns]|[ns]i|T[in]|@"),
    ("operator without operand", r"[=b+!.*]N*[)\];}]|[=b!(\[]N*b|=N*=|[(\[]N*[,=]|,N*,|\.N*[n\[{]|,;|[=b]N*\Z"),
    ("statement head", r"[wW][NZ)\]};]|l[^{w]|k[ns(]"),
]
_PYTHON = [
    ("adjacent operands", r"[n\])}is][in]|[n\])}i]s"),
    ("operator without operand", r"[=b.*+:!]*[=b.*]N|[=b+.*][)\]}:]|[(\[{=b+*][b=]|,,|[(\[{],|[rI]=|\.[ns(\[{]|F[N:]|I[N:(]*N(?!\Z)|@N"),
    ("statement head", r"(?:\A|N)(?:[wl]|a?f|aw)(?!i\.)[^N:]*(?:N|\Z)|f[^i]|l[^:io]"),
]
_RULES = {
    k: [(d, re.compile(p)) for d, p in rules] for k, rules in (("javascript", _JS), ("typescript", _TS), ("java", _JAVA), ("go", _GO), ("python", _PYTHON))
}
_TOP = {
    "java": re.compile(r"(?:@i(?:\.i)*(?:\(\))?)*(?:Pi(?:\.i)*;)?(?:Im?i(?:\.(?:i|\*|m))*;|;)*(?:(?:m|i[+][im]|@i(?:\.i)*(?:\(\))?)*(?:@?ci|ii(?:<[^{}=;]*>)?\(\))[^{}=;]*\{\};?)*\Z"),
    "go": re.compile(r"[N;]*Pi[N;]+(?:(?:I(?:i|\.|_)?s|I\(\)|d\(\)|[fd][^N;={]*(?:=[^N]*(?:(?<=[-+b,=.])N+[^N]*)*|\{\}[^N]*)?)(?:[N;]+|\Z))*\Z"),
}
_ANNOTATION = re.compile(r"@i(?:\.i)*+(?![.(i]*\()")
_DECORATOR = re.compile(r"@i(?:\.i)*\Z")
_MEMBER = re.compile(r"\.[a-zA-Z](?<![snNETDI])")
_KEY = re.compile(r"([{,]N*)[a-zA-Z](?<![snNETDK])(?=:)")
_JS_PARAMETER = re.compile(r"[(,]N*(?:D)?i:")


def _python_depth(s: str) -> str:
    """Line ends inside brackets vanish, so that one line of the string is one statement line."""
    out, depth, at = [], 0, 0
    for m in _BRACKET.finditer(s):
        piece = s[at : m.start()]
        out.append(piece.replace("N", "") if depth else piece)
        depth += 1 if m.group() in _OPEN else -1
        out.append(m.group())
        at = m.end()
    out.append(s[at:])
    return "".join(out)


_INDENT = re.compile(r"(?:[^\W\d]\w*|[@\"'(\[{.*\d#]|[^\s])")


def _indents(text: str) -> bool:
    """Whether the indents of the statement lines fit a stack of blocks. Literals and brackets hide their lines."""
    stack, opens, depth, continued = [0], False, 0, False
    lex, classes = _LEX["python"], _CLASSES["python"]
    start, blank, last, width = True, True, "", 0
    for m in lex.finditer(text):
        t = m.group(1)
        c = classes[t]
        if c == "N" and t == "\n":
            if depth == 0 and not continued and not blank:
                opens = last == ":"
                start = True
            continued = False
            blank = blank if depth or continued else (True if start else blank)
            if start:
                blank = True
            continue
        if c in (" ", "N"):
            continued = t == "\\\n"
            continue
        if start and depth == 0:
            lead = m.group()[: len(m.group()) - len(t)]
            width = len(lead.expandtabs(8))
            if opens:
                if width <= stack[-1]:
                    return False
                stack.append(width)
            else:
                while width < stack[-1]:
                    stack.pop()
                if width != stack[-1]:
                    return False
            start, opens = False, False
        blank = False
        depth += (c in "([{") - (c in ")]}")
        last = c
    return last != ":" or not blank or not start


def _json_defect(text: str) -> str | None:
    """JSON on a pushdown stack: what is open, and what may come next."""
    stack: list[str] = []
    wants = "value"  # value, value or ], name, name or }, colon, or end (a comma or the closing bracket)
    for t in _JSON.findall(text):
        c = t[0]
        if c == '"' and len(t) > 1:
            if wants in ("name", "name or }"):
                wants = "colon"
                continue
            if wants not in ("value", "value or ]"):
                return "misplaced"
            wants = "end"
        elif t in ("true", "false", "null") or (c in "-0123456789" and _JSON_NUMBER.fullmatch(t)):
            if wants not in ("value", "value or ]"):
                return "misplaced"
            wants = "end"
        elif c in "{[":
            if wants not in ("value", "value or ]"):
                return "misplaced"
            stack.append(c)
            wants = "name or }" if c == "{" else "value or ]"
        elif c in "}]":
            if not stack or stack[-1] != _CLOSE[c]:
                return "unbalanced"
            if wants not in ("end", "name or }", "value or ]"):
                return "misplaced"
            stack.pop()
            wants = "end"
        elif c == ":" and wants == "colon":
            wants = "value"
        elif c == "," and wants == "end" and stack:
            wants = "name" if stack[-1] == "{" else "value"
        else:
            return "misplaced" if c in ":," else "unreadable token"
    return None if wants == "end" and not stack else "premature end"


_JSON = re.compile(r'[ \t\n\r]*("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"|[-\d][-+.\w]*|true|false|null|[\s\S])')
_JSON_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")


def defect(text: str, language: str) -> str | None:
    """The first defect of a file's text in its language, or None when it parses."""
    text = text.removeprefix("﻿")
    if language == "json":
        found = _json_defect(text)
        if found:
            try:  # the exact check: a strict parser has the last word
                json.loads(text, parse_constant=_refuse)
                return None
            except (ValueError, RecursionError):
                pass
        return found
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\0" in text:
        return "unreadable token"
    found = _code_defect(f"\n{text}\n", language)
    if found and language == "python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(text, "f", "exec", ast.PyCF_ONLY_AST)
            return None
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            pass
    return found


def _refuse(name: str):
    raise ValueError(name)


def _code_defect(text: str, language: str) -> str | None:
    if language in ("javascript", "typescript") and text.startswith("\n#!"):
        text = text[text.find("\n", 1) :] if "\n" in text[1:] else ""
    s = _letters(text, language)
    if language != "python":  # after a dot a keyword is a name
        s = _MEMBER.sub(".i", s)
        s = _ANNOTATION.sub("N" if language == "javascript" else "m", s)
    if language in ("javascript", "typescript"):  # and so it is before a colon in an object
        s = _KEY.sub(r"\1i", s)
    if "E" in s:
        return "unreadable token" if not re.search(_MARK, text) else "merge conflict"
    if language == "python":
        s = _python_depth(s) if _walk(s, language)[1] is None else s
    marked, found = _walk(s, language)
    if found:
        return found
    body, _, top = marked.partition("\0")
    if language == "java":
        body, top = body.replace("N", ""), top.replace("N", "")
    if language == "python":
        body = re.sub(r"N+", "N", body)
    for name, rule in _RULES[language]:
        if rule.search(body):
            return name
    if language in _TOP:
        return None if _TOP[language].match(top) else "premature end" if not top.strip("N") else "top level"
    if language == "python":
        return None if _indents(text) else "indentation"
    if "r" in top.replace(".r", ""):
        return "return outside a function"
    if language == "javascript":
        depth: list[str] = []
        at = 0
        for m in _BRACKET.finditer(s):
            if depth and depth[-1] == "(" and _JS_PARAMETER.search(("(" if s[at - 1] == "(" else "") + s[at : m.start()]):
                return "type annotation"
            at = m.end()
            if m.group() in _OPEN:
                depth.append(m.group())
            elif depth:
                depth.pop()
    return None


def language_of(file_name: str | Column) -> Column:
    """The language that a file name's ending claims; null for other endings."""
    name = F.lower(F.col(file_name) if isinstance(file_name, str) else file_name)
    out = F.lit(None).cast("string")
    for ending, language in LANGUAGES.items():
        out = F.when(name.endswith(ending), F.lit(language)).otherwise(out)
    return out


@F.pandas_udf(StringType())
def _defects(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for content, language in parts:
        yield pd.Series([defect(c, k) if c is not None and k is not None else None for c, k in zip(content, language)], dtype=object)


def parse_defects(documents: DataFrame) -> DataFrame:
    """Each file of a known language: `doc_id`, `project_id`, `language`, `defect` (null: it parses).

    Rows without content or with another ending are left out. An empty file parses, but for JSON.
    """
    files = documents.select("doc_id", "project_id", language_of("file_name").alias("language"), "content")
    files = files.where(F.col("language").isNotNull() & F.col("content").isNotNull())
    return files.select("doc_id", "project_id", "language", _defects("content", "language").alias("defect"))


def defect_rates(documents: DataFrame) -> DataFrame:
    """Files, invalid files and their share per `project_id` and `language`."""
    grouped = parse_defects(documents).groupBy("project_id", "language")
    out = grouped.agg(F.count("*").alias("files"), F.count("defect").alias("invalid"))
    return out.withColumn("share", F.col("invalid") / F.col("files"))
