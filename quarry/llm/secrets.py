"""Problem 3: credentials written out in source code and configuration.

Every literal near an assignment (a name and its value, a default, a header, a flag, a comment that
states one) is segmented by Viterbi into the corpus's own dictionary words; what no word explains is
its residual, and a long residual makes it a secret. How long depends on where it stands: a name
that means a secret asks for little, a provider's format or a connection string for some, any other
name for a long residual of three kinds of characters. Hash formats outside a secret's name,
placeholders, references and ids are no secrets. Only the characters of the value are masked, one
for one, so the code around stays as it was.
"""

import base64
import binascii
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word belongs to the dictionary when at least this share of the documents has it.
WORD_SHARE = 0.01
#: Characters of a literal that the dictionary must leave unexplained under a secret's name, and under any other name.
RESIDUAL, NEUTRAL_RESIDUAL = 4, 14

# Words that make a name a secret's name, and words that make it something about one.
_SECRET = {"secret", "secrets", "password", "passwd", "pwd", "passphrase", "token", "apikey", "credential", "credentials", "passcode", "pw", "passwort"}
_SECRET_PAIRS = {("api", "key"), ("signing", "key"), ("access", "key"), ("secret", "key"), ("private", "key"), ("encryption", "key"), ("auth", "key"), ("db", "pass"), ("smtp", "pass"), ("user", "pass"), ("account", "key"), ("master", "key"), ("service", "key"), ("client", "key"), ("shared", "key"), ("encryption", "salt"), ("hashing", "salt")}
_ABOUT = {"help", "hint", "label", "notice", "message", "name", "url", "uri", "path", "file", "field", "type", "count", "length", "len", "min", "max", "ttl", "expiry", "expires", "format", "pattern", "regex", "prefix", "suffix", "title", "text", "policy", "error", "prompt", "placeholder", "header", "env", "var", "id", "ref", "arn", "kind", "description", "provider", "size", "limit", "index", "hash", "checksum"}
# Words that end the names of ids, hashes and encoded data, whose values look random and are no secrets.
_RANDOM = {"sha", "sha1", "sha256", "sha512", "md5", "digest", "etag", "fingerprint", "uuid", "guid", "ids", "revision", "commit", "rev", "nonce", "cursor", "version", "integrity", "certificate", "cert", "crt", "pem", "public", "color", "image", "img", "icon", "font", "svg", "data", "blob", "base64", "build", "trace", "span", "session", "request", "correlation", "sum", "crc", "hex", "color", "colour", "charset", "alphabet", "chars", "digits", "letters", "glyphs", "payload", "body", "src", "href", "link", "serial", "fixture", "sample", "expected", "snapshot"}
# Where a line with neither one of these nor a run of mixed characters cannot hold a secret, it is not read: names come from the words above, the rest are formats.
_HINTS = {*_SECRET, *(last for _, last in _SECRET_PAIRS), "pass", "key", "auth", "akia", "asia", "eyj", "sk-", "github_pat", "xox", "://", "basic", "bearer", " / ", "-u"}

_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
# The shapes of templates, masks and references.
_PLACEHOLDER = re.compile(
    r"(?i)<[^<>]*>|\$\{.*\}|\{\{.*\}\}|\$\(.*\)|%\(.*\)s|%[\w]+%|\{\w*\}|\[[\w -]*\]|\$[A-Za-z_]\w*|(?:x|\*|\.|-|_|#|\?|0)+|"
    r"(?:vault|env|ssm|aws|gcp|op|secretsmanager|keyring|file|kms|ref|arn|azurekv|sm)[:+].*|(?:process\.)?env\..*|@.*|/(?:run|etc|var|secrets?)/.*|.*\*{4,}.*|.*x{6,}.*"
)
# Words of placeholders; they belong to every dictionary.
_FILLERS = "a an and be by change changed changeit changeme demo do dummy empty example false fake fill fixme foo from get goes here hidden in insert is it key masked me my nil none not null of or password placeholder put real redacted replace sample secret set some tbd test the this to todo token true undefined unset value with your"
_HASH = re.compile(r"[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|(?:sha\d+|md5)[-:][\w+/=]+|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_KNOWN = re.compile(
    r"(?<![\w/+-])(?:sk-(?:[a-z]+-)?[A-Za-z0-9]{20,}|(?:AKIA|ASIA)[0-9A-Z]{16}|[a-z]{2,8}_(?:live_|test_|pat_)?(?=[A-Za-z]*\d)(?=[a-z0-9]*[A-Z])(?=[A-Z0-9]*[a-z])[A-Za-z0-9]{30,}|github_pat_\w{22,}|xox[abprs]-[\w-]{16,}|eyJ[\w-]{8,}\.eyJ[\w-]{6,}\.[\w-]{16,})(?![\w])"
)
_HEADER = re.compile(r"\b(Basic|Bearer|Token) +([\w+/.=~-]{8,})")
_URL = re.compile(r"\b[a-zA-Z][\w+.-]{0,30}://([^\s:/@\"'`<>{}$]*):([^\s/\"'`<>]+)@(?=[\w\[.-])")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY")
_PEM_LINE = re.compile(r"(?:[ \t]*(?:[\"'`*#]|//)?[ \t]*(?:[A-Za-z0-9+/=]|\\[nr])*[\"'`+,;) \t\\]*(?:\r?\n|\Z)|[A-Z][A-Za-z-]+: [^\n]*(?:\n|\Z))*")
# A literal is near an assignment when at most 200 characters lie between; without that bound a long line takes the square of its length.
_PAIR = re.compile(
    r"(?<![\w.$-])(?P<name>[A-Za-z_$][\w.$-]*+)[\"'\]]*[ \t]*(?::[ \t]*(?:string|String|str|&str|any)\??[ \t]*)?(?::=|=>|[:=])[ \t]*(?P<gap>\(?[ \t]*(?:[^\"'`\n;{}]{0,200}(?:\([ \t]*[\"'][^\"'\n]{0,200}[\"'][ \t]*,[ \t]*|(?:\|\||\?\?|\bor\b)[ \t]*))?[bruf]{0,2})(?P<q>[\"'`])(?P<v>(?:(?!(?P=q))[^\\\n]|\\.)*)(?P=q)"
)
_LITERAL = re.compile(r"([\"'`])((?:(?!\1)[^\\\n]|\\.)*)\1")
_MORE = re.compile(r"[ \t]*(?:\+[ \t]*(?:\r?\n[ \t]*)?|\\?\r?\n[ \t]*(?:\+[ \t]*)?)([\"'`])((?:(?!\1)[^\\\n]|\\.)*)\1")
_BARE = re.compile(r"^[ \t-]*(?:export[ \t]+|set[ \t]+|-[ \t]+)?[\"']?(?P<name>[A-Za-z_][\w.-]*)[\"']?[ \t]*[:=][ \t]*(?P<v>[^\s\"'`|>&!{\[(][^\s]*)[ \t]*(?:#.*)?$")
_COMMENT = re.compile(r"(?:^|[\s;{}])(?:#|//|/\*|\*|--|<!--)[ \t]*(?P<text>.*)$")
_SAID = re.compile(r"(?i)\b(?P<name>(?:[a-z]+[ _-])?(?:secret|password|passwd|pwd|pass|passphrase|token|api[ _-]?key|apikey|signing[ _-]key|access[ _-]key|private[ _-]key|credentials?))\b[ \t]*(?:=|:|\bis\b|\bwas\b)[ \t]*[\"'`]?(?P<v>[^\s\"'`]+)")
_LOGIN = re.compile(r"(?i)\b(?:log ?in|sign in|connect|user|account)\b[^/\n]{0,60} / (?P<v>\S+)")
_USER = re.compile(r"(?:\s-u|\s--user)[ =]?[\"']?[^\s:\"']+:(?P<v>[^\s\"']+)|\s(?:--password|--token|--secret|--api-key)[ =][\"']?(?P<w>[^\s\"']+)")
_KIND = re.compile(r"(?m)^([ \t]*)kind:[ \t]*[\"']?Secret\b.*$")
_RUN = re.compile(r"[A-Za-z0-9+/_=!@#%^&*~-]{14,}")
_HOOK = re.compile(r"https?://[\w.-]*\bhooks?\b[\w.-]*/[\w./-]*?/([A-Za-z0-9_-]{16,})(?![\w/-])")
_CONFIG = (".yaml", ".yml", ".sh", ".env", ".ini", ".toml", ".properties", ".conf", ".cfg", ".bash")
_LINE = re.compile(r"\r\n|\n|\r")

_automaton: ahocorasick.Automaton | None = None


def _hints() -> ahocorasick.Automaton:
    global _automaton
    if _automaton is None:
        _automaton = ahocorasick.Automaton()
        for word in _HINTS:
            _automaton.add_word(word, len(word))
        _automaton.make_automaton()
    return _automaton


def is_secret_name(name: str) -> bool:
    """Whether a name's words say that its value is a secret, and not something about one."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or words[-1] in _ABOUT:
        return False
    return bool(_SECRET & set(words)) or any(p in _SECRET_PAIRS for p in zip(words, words[1:])) or words[-1] in ("pass", "apikey") or "apikey" in "".join(words)


def _kinds(value: str) -> int:
    """How many of lower case, upper case, digits and other characters a value has."""
    return sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))


def _mixed(run: str) -> bool:
    return any(map(str.isdigit, run)) and any(map(str.islower, run)) and any(map(str.isupper, run))


def _is_key(name: str, value: str) -> bool:
    """A bare `key` or `auth` may hold anything; a secret shows by digits and by more than one kind of character."""
    return name.strip("\"'").lower() in ("key", "auth", "authkey") and _kinds(value) >= 3 and any(c.isdigit() for c in value) and not _HASH.fullmatch(value)


def _unexplained(value: str, dictionary: "Dictionary") -> bool:
    """Whether the dictionary leaves enough of a value over; made of three kinds of characters, two are enough."""
    return unexplained(value, dictionary) >= (2 if _kinds(value) >= 3 else RESIDUAL)


def _random(name: str, value: str, dictionary: "Dictionary") -> bool:
    """Whether a value under a name that says nothing is a secret: long, of three kinds of characters, mostly unexplained, in no format of hashes or data."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if len(value) < NEUTRAL_RESIDUAL or not words or words[-1] in _ABOUT or _RANDOM & set(words[-2:]):
        return False
    if not (any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)):
        return False
    if any(c.isspace() or c in "()[]{}<>:;,$|?\\\"'`" for c in value) or "." in value or "//" in value or _HASH.fullmatch(value) or not _usable(value):
        return False
    return unexplained(value, dictionary) >= max(NEUTRAL_RESIDUAL, 0.7 * sum(map(str.isalnum, value)))


def _means_secret(pair: re.Match, value: str) -> bool:
    """Whether the name assigned to, or the name of the variable that the value stands in for, means a secret."""
    read = re.findall(r"\w+", pair["gap"])
    return is_secret_name(pair["name"]) or _is_key(pair["name"], value) or bool(read) and is_secret_name(read[-1])


class Dictionary(dict):
    """Word -> cost, and the length of the longest word."""

    def __init__(self, costs: dict[str, float], fillers: str = _FILLERS):
        super().__init__({w: 3.0 for w in fillers.split()} | costs)
        self.longest = max(map(len, self), default=0)


def unexplained(literal: str, dictionary: Dictionary) -> int:
    """Letters and digits that the cheapest (Viterbi) segmentation into dictionary words leaves over.

    A word costs its negative log share, a character outside words a fixed 3.7 (one of about 40).
    """
    s = literal.lower()
    n = len(s)
    cost, left = [0.0] + [math.inf] * n, [0] * (n + 1)
    for i in range(n):
        c, l = cost[i], left[i]
        own = s[i].isalnum()
        if c + 3.7 * own < cost[i + 1]:
            cost[i + 1], left[i + 1] = c + 3.7 * own, l + own
        if own:
            for j in range(i + 2, min(n, i + dictionary.longest) + 1):
                w = dictionary.get(s[i:j])
                if w is not None and c + w < cost[j]:
                    cost[j], left[j] = c + w, l
    return left[n]


def _decodes(value: str) -> str | None:
    try:
        text = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return None
    return text if text.isprintable() and len(text) >= 4 else None


def _usable(value: str) -> bool:
    return len(value) >= 6 and not any(c.isspace() for c in value) and not _PLACEHOLDER.fullmatch(value)


def _typed(value: str, dictionary: Dictionary) -> tuple[int, int] | None:
    """The span of a credential that shows by its own format, where the dictionary does not explain it."""
    if m := _URL.search(value):
        given = m[2]
        return m.span(2) if len(given) > 2 and not _PLACEHOLDER.fullmatch(given) and unexplained(given, dictionary) >= min(2, len(given) - 1) else None
    if m := _HEADER.search(value):
        if m[1] == "Basic":
            plain = _decodes(m[2])
            return m.span(2) if plain and ":" in plain and not _PLACEHOLDER.fullmatch(plain.partition(":")[2]) and unexplained(m[2], dictionary) >= RESIDUAL else None
        return m.span(2) if _usable(m[2]) and any(c.isdigit() for c in m[2]) and unexplained(m[2], dictionary) >= RESIDUAL else None
    if m := _KNOWN.search(value):
        return m.span() if not _PLACEHOLDER.fullmatch(m[0]) and unexplained(m[0], dictionary) >= NEUTRAL_RESIDUAL else None
    if m := _HOOK.search(value):
        return m.span(1) if _random("hook", m[1], dictionary) else None
    return None


def _key_blocks(text: str) -> Iterator[tuple[int, int, int, int, bool]]:
    """(start, body start, body end, end, closed) of each private key block; one without an END line ends with its last line of key characters."""
    for m in _PEM.finditer(text):
        stop = text.find("-----", m.end())
        closed = stop >= 0 and bool(_PEM_END.match(text, stop))
        end = _PEM_LINE.match(text, m.end(), stop if stop >= 0 else len(text)).end()
        yield m.start(), m.end(), stop if closed else end, stop if closed else end, closed


def find(text: str, file_name: str | None, dictionary: Dictionary) -> list[list[tuple[int, int]]]:
    """The credentials of a text, each as the spans of its value (several where a literal is split)."""
    low = text.lower()
    if len(low) != len(text):  # a few characters change length in lower case
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    at = {end for end, _ in _hints().iter(low)} | {m.start() for m in _RUN.finditer(text) if _mixed(m[0])}
    if not at:
        return []
    found: dict[int, list[tuple[int, int]]] = {}
    covered: list[tuple[int, int]] = []

    def add(*spans: tuple[int, int]) -> None:
        if not any(a < spans[0][1] and spans[0][0] < b for a, b in covered):
            found[spans[0][0]] = list(spans)
            covered.extend(spans)

    blocks = []
    for start, a, b, end, closed in _key_blocks(text):
        blocks.append((start, end))
        runs = [m.span() for m in re.finditer(r"[A-Za-z0-9+/=]{8,}", text[a:b])]
        body = re.sub(r"\\[nr]|[\s\"'+,\\]", "", text[a:b])
        if (closed or len(body) > 200) and len(body) >= 32 and runs and re.search(r"[A-Za-z0-9+/=]{32}", body) and unexplained(body[:4096], dictionary) >= 16:
            add(*[(a + s, a + e) for s, e in runs])
            if a + runs[0][0] in found:
                found[start] = found.pop(a + runs[0][0])
    config = (file_name or "").lower().endswith(_CONFIG)
    for m in _KIND.finditer(text):
        for line in re.finditer(r"[^\n]*\n?", text[m.end() :].lstrip("\r\n")):
            if not line[0].strip():
                break
            start = len(text) - len(text[m.end() :].lstrip("\r\n")) + line.start()
            pair = re.match(r"[ \t]*[\"']?([\w.-]+)[\"']?:[ \t]*[\"']?([\w+/=-]*)[\"']?[ \t]*\r?\n?$", line[0])
            if not pair or len(line[0]) - len(line[0].lstrip(" \t")) < len(m[1]):
                break
            if pair[2] and pair[1] not in ("kind", "type", "name", "namespace", "apiVersion") and (plain := _decodes(pair[2])) and _usable(plain) and _unexplained(plain, dictionary):
                add((start + pair.start(2), start + pair.end(2)))
    done = -1
    for p in sorted(at):
        if p < done:
            continue
        start = max(text.rfind("\n", 0, p), text.rfind("\r", 0, p)) + 1
        ends = [e for e in (text.find("\n", p), text.find("\r", p)) if e >= 0]
        end = min(ends) if ends else len(text)
        done = end
        if any(a < end and start < b for a, b in blocks):
            continue
        line = text[start:end]
        pairs = {m.start("v"): m for m in _PAIR.finditer(line)}
        for m in _LITERAL.finditer(line):
            spans, value, stop = [(start + m.start(2), start + m.end(2))], m[2], start + m.end()
            while more := _MORE.match(text, stop):
                spans.append(more.span(2))
                value, stop = value + more[2], more.end()
            if typed := _typed(value, dictionary):
                add(*_parts(spans, *typed))
            elif m.start(2) in pairs and "://" not in value:
                pair = pairs[m.start(2)]
                if _means_secret(pair, value) and _usable(value) and _unexplained(value, dictionary) or _random(pair["name"], value, dictionary):
                    add(*spans)
        comment = _COMMENT.search(line)
        if (config or not comment) and (m := _BARE.match(line)) and config:
            if typed := _typed(m["v"], dictionary):
                add((start + m.start("v") + typed[0], start + m.start("v") + typed[1]))
            elif is_secret_name(m["name"]) and _usable(m["v"]) and "://" not in m["v"] and "$" not in m["v"][:2] and _unexplained(m["v"], dictionary) or _random(m["name"], m["v"], dictionary):
                add((start + m.start("v"), start + m.end("v")))
        if comment:
            for rule in (_SAID, _LOGIN):
                for m in rule.finditer(line, comment.start("text")):
                    value = m["v"].rstrip(".,;)")
                    if _usable(value) and "://" not in value and "(" not in value and not value.isalpha() and _unexplained(value, dictionary):
                        add((start + m.start("v"), start + m.start("v") + len(value)))
        for m in _USER.finditer(line):
            group = "v" if m["v"] else "w"
            if _usable(m[group]) and not m[group].startswith("$") and _unexplained(m[group], dictionary):
                add((start + m.start(group), start + m.end(group)))
        for rule in (_URL, _HEADER, _KNOWN, _HOOK):
            for m in rule.finditer(line):
                if typed := _typed(m[0], dictionary):
                    add((start + m.start() + typed[0], start + m.start() + typed[1]))
    return [found[k] and [(k, k), *found[k]] for k in sorted(found)]


def _parts(spans: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    """Offsets a..b of a joined value as spans of its parts."""
    out, base = [], 0
    for s, e in spans:
        lo, hi = max(a, base), min(b, base + e - s)
        if lo < hi:
            out.append((s + lo - base, s + hi - base))
        base += e - s
    return out


def masked(text: str, found: list[list[tuple[int, int]]], mark: str = "*") -> str:
    """The text with every character of the found values replaced by `mark`; its length stays."""
    out, at = [], 0
    for a, b in sorted(span for spans in found for span in spans if span[0] < span[1]):
        if a >= at:
            out += [text[at:a], mark * (b - a)]
            at = b
    return "".join([*out, text[at:]])


_TERM = re.compile(r"[a-z]{2,}")


def _word_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter[str] = Counter()
    for batch in batches:
        for text in batch.text:
            if text:
                counts.update(set(_TERM.findall(text.lower())))
        if len(counts) > 200_000:
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
            counts.clear()
    if counts:  # an empty frame would have no string column
        yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})


def dictionary(documents: DataFrame, share: float = WORD_SHARE) -> Dictionary:
    """Word -> cost, of the words in at least `share` of the documents, counted over all; they are at most a document's mean number of words / `share`."""
    total = documents.count()
    if not total:
        return Dictionary({})
    counts = documents.select("text").mapInPandas(_word_documents, "word string, n long")
    rows = counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, share * total))
    return Dictionary({r.word: 1.0 + math.log(total / r.n) for r in rows.collect()})


_FOUND = "origin string, row_id long, line_nos array<long>, masked string"


def scanned(documents: DataFrame, chunks: DataFrame, words: Dictionary | None = None) -> DataFrame:
    """Rows with a credential: `origin`, `row_id`, `line_nos` (1-based line where each value begins), `masked`.

    Null contents and contents without a credential give no row. Line ends \\r\\n, \\n and \\r each end a line.
    """
    words = dictionary(documents) if words is None else words
    shared = documents.sparkSession.sparkContext.broadcast(words)
    files = documents.select(F.lit("documents").alias("origin"), F.col("doc_id").alias("row_id"), "file_name", "content")
    pieces = chunks.select(F.lit("chunks").alias("origin"), F.col("chunk_id").alias("row_id"), "file_name", "content")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            out = []
            for origin, row, name, content in zip(batch.origin, batch.row_id, batch.file_name, batch.content):
                found = find(content, name, known)
                if found:
                    starts = [m.end() for m in _LINE.finditer(content)]
                    lines = sorted({bisect_right(starts, spans[0][0]) + 1 for spans in found})
                    out.append((origin, row, lines, masked(content, found)))
            yield pd.DataFrame(out, columns=["origin", "row_id", "line_nos", "masked"])

    return files.unionByName(pieces).where("content is not null and row_id is not null").mapInPandas(scan, _FOUND)
