"""URL filter: rules indexed by their rarest literal token.

A rule names a host (which also covers its subdomains) and a path prefix. Each
rule becomes one regular expression, filed under the literal token that fewest
rules hold. A URL is cut into the same tokens; they fetch the candidate rules,
and only those run their expressions. Work per URL therefore follows its own
length and the few rules sharing a rare token, not the size of the rule set.

Defined cases: a null url, or one without ``://``, has empty host and path and
fits no rule; control characters belong to the host or path they stand in; very
long urls are read whole; of rules of equal length the first by code point
wins; rows repeat as they are; other columns of the input are ignored,
whatever their names; an empty table gives an empty result. Equal rules given twice with different
verdicts are an error.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"[0-9A-Za-z]+")
#: The most bytes of rules that may be shipped to every task.
MAX_RULE_BYTES = 64 << 20
SCHEMA = "host string, path string, rule string, verdict string"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is host then path prefix (``example.com/de/``); ``verdict`` is allow or block."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]

    def tokens(self) -> set[str]:
        """Tokens that a fitting URL must hold whole.

        The path is a prefix, so a last path token without a delimiter after
        it may be longer in the URL and cannot serve as a key.
        """
        path = self.path
        whole = path[: len(path) - len(re.search(r"[0-9A-Za-z]*$", path)[0])]
        return set(_TOKEN.findall(self.host.lower())) | set(_TOKEN.findall(whole))

    def regexes(self) -> tuple[re.Pattern, re.Pattern]:
        """What the whole host and the beginning of the path must fit; apart, since either may hold any character."""
        return re.compile(rf"(?:.*\.)?{re.escape(self.host.lower())}", re.S), re.compile(re.escape(self.path))


def _lower_ascii(s: str) -> str:
    return s if s.islower() and s.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), s)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = re.search(r"[/?#]", rest)
    if cut is None:
        return _lower_ascii(rest), ""
    host, tail = rest[: cut.start()], rest[cut.start() :]
    return _lower_ascii(host), re.split(r"[?#]", tail, maxsplit=1)[0]


class RuleIndex:
    """Rules by rarest token; rules without any token are candidates for every URL."""

    def __init__(self, rules: Sequence[Rule]):
        verdicts: dict[str, str] = {}
        for r in rules:
            if r.verdict not in ("allow", "block"):
                raise ValueError(f"verdict {r.verdict!r} is neither allow nor block")
            if verdicts.setdefault(r.pattern, r.verdict) != r.verdict:
                raise ValueError(f"rule {r.pattern!r} has two verdicts")
        held = Counter(t for p, v in verdicts.items() for t in Rule(p, v).tokens())
        self.by_token: dict[str, list[tuple[int, str, str, re.Pattern, re.Pattern]]] = {}
        self.always: list[tuple[int, str, str, re.Pattern, re.Pattern]] = []
        for p, v in verdicts.items():
            rule = Rule(p, v)
            entry = (len(p), p, v, *rule.regexes())
            key = min(rule.tokens(), key=lambda t: (held[t], -len(t), t), default=None)
            (self.always if key is None else self.by_token.setdefault(key, [])).append(entry)
        # longest first, so the first rule that fits is the answer of its list
        for entries in (self.always, *self.by_token.values()):
            entries.sort(key=lambda e: (-e[0], e[1]))

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest fitting rule and its verdict; of equally long ones, the first by code point."""
        best = None
        tokens = {*_TOKEN.findall(host), *_TOKEN.findall(path)}
        found = [self.by_token[t] for t in tokens if t in self.by_token]
        for entries in [self.always, *found]:
            for size, pattern, verdict, hosts, paths in entries:
                if best is not None and (-size, pattern) >= best[:2]:
                    break
                if paths.match(path) and hosts.fullmatch(host):
                    best = (-size, pattern, verdict)
                    break
        return best and best[1:]


def judge_urls(urls: DataFrame, rules: Sequence[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per URL: id, host, path, the longest fitting rule and the verdict.

    The rules travel with the task, so their size is checked; no row is shuffled.
    """
    if sum(len(r.pattern) for r in rules) > MAX_RULE_BYTES:
        raise ValueError(f"the rules exceed {MAX_RULE_BYTES} bytes")
    RuleIndex(rules)  # refuse bad rules before a job starts
    rules = list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules)
        for b in batches:
            hosts, paths, names, verdicts = [], [], [], []
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                found = index.judge(host, path) if host or path else None
                hosts.append(host)
                paths.append(path)
                names.append(found[0] if found else None)
                verdicts.append(found[1] if found else default)
            text = pa.string()
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, text) for x in (hosts, paths, names, verdicts))], names=[id_col, "host", "path", "rule", "verdict"])

    thin = urls.select(urls[id_col], urls[url_col])
    return thin.mapInArrow(run, f"{id_col} {thin.schema[0].dataType.simpleString()}, {SCHEMA}")
