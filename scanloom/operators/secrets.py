"""Secret scan over many rules: keywords by one automaton, then only the patterns whose keyword a text holds.

Rules are data of this package, in its own words. All keywords go into one trie with failure links, kept as a table of
next states, and a batch of texts is walked through it side by side, a byte of each at a time; the cost of
that does not depend on the number of rules. A pattern is tried on the whole text, so a secret may
span lines. Entropy and the allow list judge what was found, as column expressions.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text walked side by side, and bytes of one text that a lane holds; longer texts take several lanes.
BATCH_BYTES, LANE = 8 << 20, 2048
#: No byte of UTF-8: it ends a text and leads back to the start.
_STOP = 255


@dataclass(frozen=True)
class KeyedRule:
    """A pattern (Python and RE2 syntax, ASCII classes) that is tried where one of the keywords occurs, in any case.

    The secret is ``group`` of a match. It counts if its entropy in bits a character is ``entropy`` or more and no
    pattern of ``allow`` is found in it. A rule without keywords is tried on every text.
    """

    id: str
    pattern: str
    keywords: tuple[str, ...]
    group: int = 0
    description: str = ""
    entropy: float = 0.0
    allow: tuple[str, ...] = ()


#: Published prefixes and forms of credentials.
KEYED_RULES = (
    KeyedRule("quoted-credential", r'(?i)(?:password|passwd|secret|token|api[_-]?key)\s*[=:]\s*"([^"\n]+)"',
              ("password", "passwd", "secret", "token", "api_key", "api-key", "apikey"), 1, "Credential in quotes", 2.5, ("(?i)example|changeme|your[_-]",)),
    KeyedRule("hex-token", r"\b([0-9a-f]{40})\b", ("token", "sha", "key"), 1, "Forty hexadecimal digits", 3.0),
    KeyedRule("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", ("private key-----",), 0, "Private key block"),
    KeyedRule("cloud-access-key", r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b", ("akia", "asia"), 1, "Cloud access key", 3.0, ("EXAMPLE",)),
    KeyedRule("forge-token", r"\b(gh[pousr]_[A-Za-z0-9]{36})\b", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), 1, "Forge token", 3.0),
    KeyedRule("chat-token", r"\b(xox[abprs]-[A-Za-z0-9-]{10,})", ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), 1, "Chat token"),
    KeyedRule("payment-key", r"\b([rs]k_live_[A-Za-z0-9]{16,})\b", ("sk_live_", "rk_live_"), 1, "Payment key", 3.0),
    KeyedRule("signed-token", r"\b(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", ("eyj",), 1, "Signed web token"),
    KeyedRule("bearer-header", r"(?i)authorization:\s*bearer\s+([A-Za-z0-9._~+/-]{16,}=*)", ("authorization",), 1, "Bearer token in a header", 3.0),
    KeyedRule("url-password", r"://[^/\s:@]+:([^/\s:@]+)@", ("://",), 1, "Password inside a URL"),
    KeyedRule("mail-address", r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b", ("@",), 1, "Mail address"),
    KeyedRule("after-line-break", r'(?i)\b(?:secret|token|password)\s*[=:]\s*\n\s*"?([A-Za-z0-9+/_-]{16,})"?', ("secret", "token", "password"), 1, "Credential on the next line", 3.0),
)


class Automaton:
    """All keywords of the rules, ASCII letters alike in both cases, as a table: next state by state and class of byte."""

    def __init__(self, rules: Sequence[KeyedRule]) -> None:
        words: dict[bytes, list[int]] = {}
        for n, rule in enumerate(rules):
            for keyword in rule.keywords:
                words.setdefault(keyword.encode().lower(), []).append(n)
        if b"" in words:
            raise ValueError("a keyword may not be empty")
        self.always = [n for n, rule in enumerate(rules) if not rule.keywords]
        self.longest = max(map(len, words), default=0)
        used = sorted({b for w in words for b in w})
        self.classes = np.zeros(256, np.int32)
        for k, b in enumerate(used):
            self.classes[b] = k + 1
            if 97 <= b <= 122:
                self.classes[b - 32] = k + 1
        trie: list[dict[int, int]] = [{}]
        ends: list[set[int]] = [set()]
        for word, holders in words.items():
            state = 0
            for b in word:
                state = trie[state].setdefault(int(self.classes[b]), len(trie))
                if state == len(trie):
                    trie.append({})
                    ends.append(set())
            ends[state].update(holders)
        # Breadth first: a state's failure link is shallower and complete when the state is reached.
        width = len(used) + 1
        self.step = np.zeros((len(trie), width), np.int32)
        fail = [0] * len(trie)
        waiting = deque([0])
        while waiting:
            state = waiting.popleft()
            if state:
                self.step[state] = self.step[fail[state]]
                ends[state] |= ends[fail[state]]
            for c, after in trie[state].items():
                fail[after] = int(self.step[fail[state], c]) if state else 0
                self.step[state, c] = after
                waiting.append(after)
        self.rules_of = [sorted(e) for e in ends]
        self.ends = np.array([bool(e) for e in ends])
        self.width = width

    @cached_property
    def flat(self) -> np.ndarray:
        """``step`` with states multiplied by the width, so that a step is one addition and one look-up."""
        return (self.step * self.width).ravel()

    def holders(self, data: np.ndarray, offsets: np.ndarray) -> list[set[int]]:
        """For each text, ``data[offsets[k]:offsets[k + 1]]``, the rules one of whose keywords it holds."""
        found = [set(self.always) for _ in range(len(offsets) - 1)]
        sizes = np.diff(offsets)
        if not self.longest or not len(data):
            return found
        lanes = -(-sizes // LANE)
        text = np.repeat(np.arange(len(sizes)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = offsets[:-1][text] + nth * LANE
        # A lane reads on into the next one's share, so that no keyword is cut.
        stop = np.minimum(start + LANE + self.longest - 1, offsets[1:][text])
        order = np.argsort(start - stop, kind="stable")
        text, start, size = text[order], start[order], (stop - start)[order]
        kinds = self.classes[data]
        states = np.zeros(len(text), np.int64)
        seen = np.zeros((len(found), len(self.ends)), bool) if len(found) * len(self.ends) <= 1 << 26 else None
        hits: set[tuple[int, int]] = set()
        going = len(text)
        for at in range(int(size[0])):
            going = int(np.searchsorted(-size[:going], -at, "left"))
            states[:going] = self.flat[states[:going] + kinds[start[:going] + at]]
            ended = np.flatnonzero(self.ends[states[:going] // self.width])
            if len(ended):
                at_state = states[ended] // self.width
                if seen is not None:
                    seen[text[ended], at_state] = True
                else:
                    hits.update(zip(text[ended].tolist(), at_state.tolist()))
        for k, state in zip(*np.nonzero(seen)) if seen is not None else hits:
            found[k].update(self.rules_of[state])
        return found


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a column of strings: first row, bytes, offsets; a null is empty."""
    first, size = 0, 0
    lengths = [len(t.as_buffer()) if t.is_valid else 0 for t in column]
    for n, length in enumerate([*lengths, None]):
        if n > first and (length is None or size + length > BATCH_BYTES):
            parts = [t.as_buffer() if t.is_valid else b"" for t in column.slice(first, n - first)]
            yield first, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *lengths[first:n]])
            first, size = n, 0
        size += length or 0


def entropy(text: Column) -> Column:
    """Shannon entropy of a string in bits a character; 0 for the empty one, null for null."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda sum_, c: sum_ - share(c) * F.log2(share(c)))
    return F.when(text.isNull(), None).when(F.length(text) == 0, 0.0).otherwise(bits)


def candidates(files: DataFrame, rules: Sequence[KeyedRule] = KEYED_RULES) -> DataFrame:
    """A row for each match: scan_id, scan_root, path, ``rule`` (its number), ``start``, ``line_start``, ``line_end``, ``secret``.

    ``start`` counts characters. Lines count from 1. Files are read where they are, without an exchange; only
    matches leave. A null text has none. Matches of one rule do not overlap, those of different rules may.
    """
    keys = ["scan_id", "scan_root", "path"]
    schema = files.select(*keys, F.col("text").cast("string")).select(*keys).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(rules)
        patterns = [re.compile(r.pattern, re.ASCII) for r in rules]
        for batch in batches:
            for first, data, offsets in _texts(batch.column(3)):
                rows: list[tuple] = []
                for k, held in enumerate(automaton.holders(data, offsets)):
                    if not held:
                        continue
                    text = data[offsets[k] : offsets[k + 1]].tobytes().decode()
                    for n in sorted(held):
                        line, before = 1, 0
                        for match in patterns[n].finditer(text):
                            line += text.count("\n", before, match.start())
                            before = match.start()
                            last = line + match.group().count("\n")
                            rows.append((first + k, n, match.start(), line, last, match.group(rules[n].group)))
                of, *found = zip(*rows, strict=True) if rows else [()] * 6
                of = pa.array(of, pa.int64())
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
                columns = [batch.column(c).take(of) for c in range(3)] + [pa.array(v, t) for v, t in zip(found, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "rule", "start", "line_start", "line_end", "secret"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    rows = files.select(*keys, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(apply, f"{shape}, rule int, start long, line_start int, line_end int, secret string")


def keyed_findings(files: DataFrame, rules: Sequence[KeyedRule] = KEYED_RULES) -> DataFrame:
    """Files (scan_id, scan_root, path, text) to findings in the secret dialect; see ``KeyedRule`` for what counts.

    ``at`` and ``nth`` are the start of the match and the number of its rule: unique and in order within a file.
    """
    if not rules:
        raise ValueError("no rules")
    rule = F.array(*[
        F.struct(
            F.lit(r.id).alias("id"),
            F.lit(r.description).alias("description"),
            F.lit(float(r.entropy)).alias("entropy"),
            F.lit("|".join(f"(?:{a})" for a in r.allow) or None).cast("string").alias("allow"),
        )
        for r in rules
    ])[F.col("rule")]
    found = candidates(files, rules).where(F.col("secret").isNotNull())
    kept = found.where((entropy(F.col("secret")) >= rule["entropy"]) & ~F.coalesce(F.regexp_like("secret", rule["allow"]), F.lit(False)))
    finding = F.struct(
        rule["description"].alias("Description"),
        F.col("line_start").alias("StartLine"),
        F.col("line_end").alias("EndLine"),
        F.col("path").alias("File"),
        F.col("secret").alias("Secret"),
        rule["id"].alias("RuleID"),
    )
    return kept.select("scan_id", "scan_root", F.col("start").alias("at"), F.col("rule").alias("nth"), finding.alias("f"))
