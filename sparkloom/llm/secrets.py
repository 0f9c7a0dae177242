"""Secret scans: keyword automaton, anchored expressions near hits, checksums.

An Aho-Corasick automaton passes once over each text and finds all keywords.  A
rule's regular expression is tried only at positions that a hit of its keyword fixes,
anchored there, never searched for in the text.  Secrets whose form embeds a
checksum or a decodable structure are then validated; those that fail are dropped, and
a failed checksum also rules out what other rules make of the same characters.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, table

_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_B58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def crc62(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _B62[r] + out
    return out


def _crc_tail(s: str) -> bool:
    """Six last characters are the CRC-32 of the random part after the prefix."""
    body = s.split("_", 1)[1]
    return crc62(body[:-6]) == body[-6:]


def _jwt(s: str) -> bool:
    try:
        head, body, _ = s.split(".")
        h, b = (json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in (head, body))
        return isinstance(h, dict) and "alg" in h and isinstance(b, dict)
    except (ValueError, binascii.Error, RecursionError):
        return False


def _base58check(s: str) -> bool:
    n = 0
    for c in s:
        n = n * 58 + _B58.index(c)
    raw = n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")
    return len(raw) in (37, 38) and raw[0] == 0x80 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _pem(s: str) -> bool:
    """The body is base64 of a key's structure, or of whole cipher blocks where headers say that it is encrypted."""
    body = re.sub(r"-----[A-Z ]+-----", "", s)
    encrypted = re.search(r"Proc-Type:\s*4,\s*ENCRYPTED", body)
    try:
        raw = base64.b64decode(re.sub(r"\s", "", re.sub(r"(?m)^[A-Za-z0-9-]+:[^\n]*$", "", body)), validate=True)
    except (ValueError, binascii.Error):
        return False
    return len(raw) > 32 and (len(raw) % 8 == 0 if encrypted else raw[0] == 0x30 or raw.startswith(b"openssh-key-v1"))


def _entropy(s: str) -> bool:
    """At least 3 bits a character: rules out words and repeated characters."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) >= 3.0


def _mixed(s: str) -> bool:
    """``_entropy``, and two of lower case, upper case and digits: rules out names in code, as nothing else marks where an unquoted value is text."""
    return _entropy(s) and any(map(str.isalpha, s)) and sum((any(map(str.islower, s)), any(map(str.isupper, s)), any(map(str.isdigit, s)))) >= 2


@dataclass(frozen=True)
class Rule:
    name: str
    #: Lower-case keywords; the expression is anchored where a hit starts.
    keywords: tuple[str, ...]
    pattern: str
    check: Callable[[str], bool] | None = None
    #: ``checksum`` or ``structure`` if ``check`` proves the secret genuine, ``entropy`` if it only rules out others.
    proof: str = "entropy"
    flags: int = 0


#: Names before a value; the rules' keywords and their expression are both made of them.
_SHORT = ("token", "secret", *(a + sep + "key" for a in ("api", "access", "auth", "private") for sep in ("", "_", "-")))
_KEYS = (*_SHORT, "password", "passwd")


def _named(names: tuple[str, ...]) -> str:
    return rf"""(?:{"|".join(names)})["']?\s{{0,3}}(?::=|=>|=|:)\s{{0,3}}"""


#: A character of an unquoted value.  Without separators no value holds the start of another, so the time stays linear.
_BARE = r"""[^\s"'`=:;,.?<>(){}\[\]|&\\]"""
RULES = (
    Rule("code_host_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"(gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])", _crc_tail, "checksum"),
    Rule("package_token", ("npm_",), r"(npm_[A-Za-z0-9]{36})(?![A-Za-z0-9])", _crc_tail, "checksum"),
    Rule("web_token", ("eyj",), r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]{8,})", _jwt, "structure"),
    Rule("private_key", ("-----begin",), r"(-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----(?:\s*[A-Za-z0-9-]{1,40}:[^\n]{0,200}\n){0,8}[A-Za-z0-9+/=\s]{40,}-----END [A-Z ]{0,20}PRIVATE KEY-----)", _pem, "structure"),
    Rule("wallet_key", ("wif", "wallet", "privkey"), r"""(?:wif|wallet|privkey)["']?\s{0,3}(?:=|:)\s{0,3}["']?([5KL][1-9A-HJ-NP-Za-km-z]{50,51})(?![A-Za-z0-9])""", _base58check, "checksum", re.I),
    Rule("cloud_key_id", ("akia", "asia"), r"((?:AKIA|ASIA)[A-Z2-7]{16})(?![A-Za-z0-9])", _entropy),
    Rule("chat_token", ("xox",), r"(xox[abprs]-[A-Za-z0-9-]{20,})", _entropy),
    Rule("payment_key", ("sk_live_", "rk_live_"), r"([sr]k_live_[A-Za-z0-9]{20,})", _entropy),
    Rule("map_key", ("aiza",), r"(AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9_-])", _entropy),
    Rule("named_secret", _KEYS, _named(_KEYS) + r"""["']([A-Za-z0-9+/_.=~-]{16,})["']""", _entropy, "entropy", re.I),
    Rule("named_hex", _SHORT, _named(_SHORT) + r"([0-9a-f]{32,})(?![0-9A-Za-z])", _entropy, "entropy", re.I),
    Rule("named_quoted", _KEYS, _named(_KEYS) + r"""(?:"(?=[^"\s]{16,}")|'(?=[^'\s]{16,}'))((?<=")[^"\s]+|(?<=')[^'\s]+)""", _entropy, "entropy", re.I),
    Rule("named_bare", _KEYS, _named(_KEYS) + rf"((?>(?:{_BARE}|[.?](?={_BARE})){{16,}}={{0,2}}))(?![(\[{{=:])", _mixed, "entropy", re.I),
)


def _lower(text: str) -> str:
    """Lower case that keeps every position, as expressions that ignore case read it (long s is an s to them)."""
    low = text.lower().replace("\u017f", "s")
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text).replace("\u017f", "s")


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.compiled = [re.compile(r.pattern, r.flags) for r in rules]
        by: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            for k in r.keywords:
                by.setdefault(k, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for k, of in by.items():
            self.automaton.add_word(k, (len(k), tuple(of)))
        self.automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[str, int, int, str, str]]:
        """(rule, start, end, secret, proof), by position; of findings that cover the same characters the first rule's stays.

        What has the form of a checksum rule and fails its checksum is no secret by any
        other rule that only measures entropy: findings that overlap it go.
        """
        found: dict[tuple[int, int], tuple] = {}
        failed: list[tuple[int, int]] = []
        for end, (n, of) in self.automaton.iter(_lower(text)):
            at = end - n + 1
            for i in of:
                m = self.compiled[i].match(text, at)
                if not m:
                    continue
                rule, secret = self.rules[i], m.group(1)
                span = m.span(1)
                if rule.check and not rule.check(secret):
                    if rule.proof == "checksum":
                        failed.append(span)
                    continue
                if span not in found or found[span][0] > i:
                    found[span] = (i, secret)
        return [(self.rules[i].name, a, b, s, self.rules[i].proof) for (a, b), (i, s) in sorted(found.items()) if self.rules[i].proof != "entropy" or not any(x < b and a < y for x, y in failed)]


_scanner: list[Scanner] = []


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    if not _scanner:
        _scanner.append(Scanner())
    scan = _scanner[0].scan
    for pdf in batches:
        out = [(i, rule, a, b, hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest(), s[:4] + "*" * 4, proof) for i, t in zip(pdf["doc_id"].array, pdf["text"]) for rule, a, b, s, proof in scan(t)]
        yield pd.DataFrame(out, columns=["doc_id", "rule", "start", "end", "secret_sha256", "shown", "proof"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, rule, start, end, secret_sha256, shown, proof)``, one row a finding.

    Positions count characters from 0.  The secret itself is not given, only its
    digest and first four characters.  ``proof`` says what validated it: ``checksum``,
    ``structure`` or ``entropy``; candidates that fail are absent, and so are those of
    ``entropy`` that overlap one whose checksum fails.  Null and empty
    texts have no findings, null ids stay null, repeated rows are scanned each, texts
    of any length are scanned whole.  Extra columns are not read.
    """
    rows = docs.select(col(id_col).cast("string").alias("doc_id"), col(text_col).cast("string").alias("text")).where("text IS NOT NULL AND text <> ''")
    kind = docs.schema[id_col].dataType
    out = rows.mapInPandas(_scan, "doc_id string, rule string, start int, end int, secret_sha256 string, shown string, proof string")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return scan_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op5_secret_scans": op5_secret_scans}
ORACLE: dict[str, str] = {}
