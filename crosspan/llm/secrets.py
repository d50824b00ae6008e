"""Secret scans: Aho-Corasick keyword prefilter, anchored patterns near the hits, embedded checksums.

One automaton pass finds the fixed keywords that each rule needs. A rule's anchored pattern is then
tried only at its keywords' places, and rules whose tokens carry a checksum (the base62 CRC-32 of GitHub and
npm, Bech32, Base58Check, Luhn, IBAN mod 97) or a form inside (JWT's JSON header, PyPI's issuer, Azure's 64
bytes) are kept only if it holds. What follows a card number or an
IBAN may look like more of it, so all their admissible ends are tried, the longest first; an IBAN has
the length of its country, where that is known. Their keywords are found in either case.

Defined results: null and empty texts have no spans; repeated rows each give their own row; tables
without rows give none; columns other than the id and the text are neither read nor returned by
:func:`find_secrets`, and pass through :func:`redact_secrets` unchanged.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspan.llm.common import text_of

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def github_checksum(token: str) -> bool:
    """The last six base62 digits are the CRC-32 of the part between the prefix and them."""
    body, check = token[4:-6], token[-6:]
    value = binascii.crc32(body.encode())
    digits = ""
    while value:
        value, rest = divmod(value, 62)
        digits = BASE62[rest] + digits
    return digits.rjust(6, "0") == check


def luhn(token: str) -> bool:
    digits = [int(c) for c in token if c.isdigit()]
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


#: Lengths of the countries' IBANs.
IBAN_LENGTHS = {
    n: codes.split()
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}
LENGTH_OF = {code: n for n, codes in IBAN_LENGTHS.items() for code in codes}


def iban(token: str) -> bool:
    compact = token.replace(" ", "")
    if not 15 <= len(compact) <= 34 or len(compact) != LENGTH_OF.get(compact[:2], len(compact)):
        return False
    moved = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def jwt(token: str) -> bool:
    head = token.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


def bech32(token: str) -> bool:
    """The checksum of a human-readable part, a 1 and base-32 digits, in one case."""
    head, _, data = token.lower().rpartition("1")
    values = [ord(c) >> 5 for c in head] + [0] + [ord(c) & 31 for c in head] + ["qpzry9x8gf2tvdw0s3jn54khce6mua7l".find(c) for c in data]
    if -1 in values:
        return False
    total = 1
    for v in values:
        top, total = total >> 25, (total & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            total ^= g if top >> i & 1 else 0
    return total == 1


def base58check(token: str) -> bool:
    """The last four of the bytes are the first of the others' SHA-256, taken twice."""
    value = 0
    for c in token:
        value = value * 58 + "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz".index(c)
    raw = value.to_bytes(82, "big")  # an extended key has 78 bytes and the checksum
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def pypi(token: str) -> bool:
    """The macaroon in it begins with its issuer."""
    body = token.removeprefix("pypi-")
    try:
        return b"pypi.org" in base64.urlsafe_b64decode(body + "=" * (-len(body) % 4))[:16]
    except ValueError:
        return False


def azure(token: str) -> bool:
    try:
        return len(base64.b64decode(token, validate=True)) == 64
    except ValueError:
        return False


#: kind, keywords (as they stand in the text; those of OPEN_ENDED in lower case), anchored pattern, characters before the keyword at
#: which the pattern may begin, and the checksum (None: none is embedded).
RULES = (
    ("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), 0, github_checksum),
    ("jwt", ("eyJ",), re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, jwt),
    ("pem", ("-----BEGIN ",), re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"), 0, None),
    ("slack", ("xoxb-", "xoxp-", "xoxa-", "xoxr-"), re.compile(r"xox[bpar]-[0-9]{6,}-[A-Za-z0-9-]{10,}"), 0, None),
    ("stripe", ("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_[A-Za-z0-9]{16,}"), 0, None),
    ("google", ("AIza",), re.compile(r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"), 0, None),
    ("npm", ("npm_",), re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), 0, github_checksum),
    ("github_pat", ("github_pat_",), re.compile(r"github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59}(?![A-Za-z0-9])"), 0, None),
    ("gitlab", ("glpat-", "gldt-", "glrt-", "glptt-"), re.compile(r"gl(?:pat|dt|rt|ptt)-[A-Za-z0-9_-]{20,}"), 0, None),
    ("pypi", ("pypi-",), re.compile(r"pypi-[A-Za-z0-9_-]{50,}"), 0, pypi),
    ("aws_secret", ("aws_secret_access_key", "AWS_SECRET_ACCESS_KEY"), re.compile(r"""(?i:aws_secret_access_key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9/+]{40})(?![A-Za-z0-9/+=])"""), 0, None),
    ("aws_temporary", ("ASIA",), re.compile(r"ASIA[A-Z0-9]{16}(?![A-Z0-9])"), 0, None),
    ("azure_storage", ("AccountKey=",), re.compile(r"AccountKey=([A-Za-z0-9+/]{86}==)"), 0, azure),
    ("google_oauth", ("GOCSPX-",), re.compile(r"GOCSPX-[A-Za-z0-9_-]{28}(?![A-Za-z0-9_-])"), 0, None),
    ("google_access", ("ya29.",), re.compile(r"ya29\.[A-Za-z0-9_-]{30,}"), 0, None),
    ("age", ("AGE-SECRET-KEY-1",), re.compile(r"AGE-SECRET-KEY-1[A-Z0-9]{58}(?![A-Z0-9])"), 0, bech32),
    ("nostr", ("nsec1",), re.compile(r"nsec1[a-z0-9]{58}(?![a-z0-9])"), 0, bech32),
    ("extended_key", ("xprv",), re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])"), 0, base58check),
    ("sendgrid", ("SG.",), re.compile(r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}(?![A-Za-z0-9_-])"), 0, None),
    ("mailgun", ("key-",), re.compile(r"key-[0-9a-f]{32}(?![0-9A-Za-z])"), 0, None),
    ("brevo", ("xkeysib-",), re.compile(r"xkeysib-[a-f0-9]{64}-[A-Za-z0-9]{16}(?![A-Za-z0-9])"), 0, None),
    ("twilio", ("SK", "AC"), re.compile(r"(?:SK|AC)[0-9a-f]{32}(?![0-9A-Za-z])"), 0, None),
    ("slack_hook", ("https://hooks.slack.com/",), re.compile(r"https://hooks\.slack\.com/services/T[A-Z0-9]{8,}/B[A-Z0-9]{8,}/[A-Za-z0-9]{24}(?![A-Za-z0-9])"), 0, None),
    ("slack_app", ("xapp-",), re.compile(r"xapp-[0-9]-[A-Z0-9]+-[0-9]+-[a-f0-9]{64}(?![A-Za-z0-9])"), 0, None),
    ("discord_hook", ("https://discord.com/api/webhooks/",), re.compile(r"https://discord\.com/api/webhooks/[0-9]{17,20}/[A-Za-z0-9_-]{60,}"), 0, None),
    ("stripe_hook", ("whsec_",), re.compile(r"whsec_[A-Za-z0-9+/]{32,}=*"), 0, None),
    ("stripe_test", ("sk_test_", "rk_test_"), re.compile(r"[sr]k_test_[A-Za-z0-9]{16,}"), 0, None),
    ("square", ("sq0atp-", "sq0csp-"), re.compile(r"sq0(?:atp-[A-Za-z0-9_-]{22}|csp-[A-Za-z0-9_-]{43})(?![A-Za-z0-9_-])"), 0, None),
    ("shopify", ("shpat_", "shpca_", "shppa_", "shpss_"), re.compile(r"shp(?:at|ca|pa|ss)_[A-Fa-f0-9]{32}(?![A-Za-z0-9])"), 0, None),
    ("digitalocean", ("dop_v1_", "doo_v1_", "dor_v1_"), re.compile(r"do[opr]_v1_[a-f0-9]{64}(?![A-Za-z0-9])"), 0, None),
    ("databricks", ("dapi",), re.compile(r"dapi[a-f0-9]{32}(?:-[0-9])?(?![A-Za-z0-9])"), 0, None),
    ("huggingface", ("hf_",), re.compile(r"hf_[A-Za-z]{34}(?![A-Za-z0-9])"), 0, None),
    ("openai", ("sk-",), re.compile(r"sk-(?:proj-)?[A-Za-z0-9_-]{20,}T3BlbkFJ[A-Za-z0-9_-]{20,}"), 0, None),
    ("linear", ("lin_api_",), re.compile(r"lin_api_[A-Za-z0-9]{40}(?![A-Za-z0-9])"), 0, None),
    ("notion", ("ntn_", "secret_"), re.compile(r"(?:ntn_[A-Za-z0-9]{46}|secret_[A-Za-z0-9]{43})(?![A-Za-z0-9])"), 0, None),
    ("new_relic", ("NRAK-",), re.compile(r"NRAK-[A-Z0-9]{27}(?![A-Z0-9])"), 0, None),
    ("grafana", ("glsa_",), re.compile(r"glsa_[A-Za-z0-9]{32}_[A-Fa-f0-9]{8}(?![A-Za-z0-9])"), 0, None),
    ("vault", ("hvs.", "hvb."), re.compile(r"hv[bs]\.[A-Za-z0-9_-]{24,}"), 0, None),
    ("postman", ("PMAK-",), re.compile(r"PMAK-[a-f0-9]{24}-[a-f0-9]{34}(?![A-Za-z0-9])"), 0, None),
    ("pulumi", ("pul-",), re.compile(r"pul-[a-f0-9]{40}(?![A-Za-z0-9])"), 0, None),
    ("rubygems", ("rubygems_",), re.compile(r"rubygems_[a-f0-9]{48}(?![A-Za-z0-9])"), 0, None),
    ("docker", ("dckr_pat_",), re.compile(r"dckr_pat_[A-Za-z0-9_-]{27}(?![A-Za-z0-9_-])"), 0, None),
    ("planetscale", ("pscale_tkn_", "pscale_pw_"), re.compile(r"pscale_(?:tkn|pw)_[A-Za-z0-9_.=-]{32,}"), 0, None),
    ("supabase", ("sbp_",), re.compile(r"sbp_[a-f0-9]{40}(?![A-Za-z0-9])"), 0, None),
    ("figma", ("figd_",), re.compile(r"figd_[A-Za-z0-9_-]{40,}"), 0, None),
    ("atlassian", ("ATATT3",), re.compile(r"ATATT3[A-Za-z0-9_=-]{180,}"), 0, None),
    ("doppler", ("dp.pt.",), re.compile(r"dp\.pt\.[A-Za-z0-9]{43}(?![A-Za-z0-9])"), 0, None),
    ("url_password", ("://",), re.compile(r"://[^\s/:@\"'<>]+:([^\s/:@\"'<>]{3,})@[A-Za-z0-9]"), 0, None),
    ("card", ("card",), re.compile(r"(?i:card(?: number| no)?)[ :=]{1,3}((?:[0-9][ -]?){12,18}[0-9])(?![0-9])"), 0, luhn),
    ("iban", ("iban",), re.compile(r"(?i:iban)[ :=]{1,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Z0-9])"), 0, iban),
)
#: Kinds whose match may be too long: a shorter token ends before one of these characters at no place.
OPEN_ENDED = {"card": re.compile(r"[0-9]"), "iban": re.compile(r"[A-Z0-9]")}


class Scanner:
    """Finds the spans of a text: (start, end, kind), in code points, end exclusive."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        wanted: dict[str, list] = {}
        for rule in RULES:
            for word in rule[1] if rule[0] not in OPEN_ENDED else ():
                wanted.setdefault(word, []).append(rule)
        wanted.setdefault("AKIA", []).append("access")
        for word, rules in wanted.items():
            self.automaton.add_word(word, (len(word), rules))
        self.automaton.make_automaton()
        self.lower = ahocorasick.Automaton()
        for word in ASSIGN_WORDS:
            self.lower.add_word(word, (len(word), []))
        for rule in RULES:
            for word in rule[1] if rule[0] in OPEN_ENDED else ():
                self.lower.add_word(word, (len(word), [rule]))
        self.lower.make_automaton()

    def assigns(self, text: str, hits: list[tuple[int, tuple[int, list]]]) -> list[tuple[int, int]]:
        """Leftmost non-overlapping assignments whose value has 8 or more characters."""
        # The pattern begins with a keyword, so it can match only where the automaton has hit.
        out, free = [], 0
        for start in sorted({end - n + 1 for end, (n, rules) in hits if not rules}):
            if start >= free and (m := ASSIGN.match(text, start)):
                free = m.end()
                if m.end(2) - m.start(2) >= 8:
                    out.append((m.start(), m.end()))
        return out

    def end(self, rule: tuple, text: str, at: int, span: tuple[int, int]) -> int | None:
        """The furthest admissible end of the token in ``span`` at which its checksum holds."""
        start, last = span
        for stop in range(last, start, -1):
            if stop < last and OPEN_ENDED[rule[0]].match(text, stop):
                continue
            m = rule[2].fullmatch(text, at, stop)
            if m and m.start(1) == start and rule[4](m.group(1)):
                return stop
        return None

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        if not text:
            return []
        low = text.lower() if text.isascii() else "".join(c.lower() if c < "\x80" else c for c in text)
        hits = list(self.lower.iter(low))
        found = [(s, e, "assign") for s, e in self.assigns(text, hits)]
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
        free: dict[str, int] = {}
        for end, (n, rules) in (*self.automaton.iter(text), *hits):
            at = end - n + 1
            for rule in rules:
                kind = rule if isinstance(rule, str) else rule[0]
                if at < free.get(kind, 0):
                    continue
                if kind == "access":
                    if m := ACCESS.match(text, at):
                        free[kind] = m.end()
                        if m.end() - at >= 16:
                            found.append((at, m.end(), kind))
                elif m := rule[2].match(text, at):
                    group = 1 if rule[2].groups else 0
                    if kind in OPEN_ENDED:
                        if stop := self.end(rule, text, at, m.span(1)):
                            free[kind] = stop
                            found.append((m.start(1), stop, kind))
                    elif rule[4] is None or rule[4](m.group(group)):
                        free[kind] = m.end()
                        found.append((m.start(group), m.end(group), kind))
        order = {k: i for i, k in enumerate((*KINDS, *(r[0] for r in RULES)))}
        return sorted(found, key=lambda x: (x[0], order[x[2]], x[1]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col`` and ``spans`` array<struct<start,end,kind>>."""

    @F.pandas_udf("array<struct<start:long,end:long,kind:string>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner()
        for texts in batches:
            yield pd.Series([[{"start": s, "end": e, "kind": k} for s, e, k in scanner.spans(t)] for t in texts])

    return docs.select(docs[id_col], scan(text_of(docs, text_col)).alias("spans"))


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`find_secrets` as counts and digests, one row per document."""
    found = find_secrets(docs, id_col, text_col)
    base = F.filter("spans", lambda x: x.kind.isin(*KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long")
    return found.select(
        id_col,
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``[secret:kind]``; all else, null texts too, as it was."""

    @F.pandas_udf("string")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner()

        def clean(text: str | None) -> str | None:
            spans = scanner.spans(text) if text else []
            if not spans:
                return text
            out, at = [], 0
            for start, end, kind in spans:
                if start >= at:
                    out += [text[at:start], f"[secret:{kind}]"]
                at = max(at, end)
            return "".join([*out, text[at:]])

        for texts in batches:
            yield texts.map(clean, na_action="ignore")

    return docs.withColumn(text_col, redact(docs[text_col]))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
