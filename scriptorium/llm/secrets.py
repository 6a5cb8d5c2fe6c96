"""Secret scans: candidates by pattern, false positives removed by a random forest,
with SQL functions only on the data.

Candidates are of three kinds: values assigned to a name that speaks of secrets
(quoted, or up to a space, with any punctuation, 6 characters or more); strings in the
form of an issued key; and runs of at least 12 token characters with a digit, with the
name they are assigned to, if any. Up to two words before a candidate and two after it
are its neighbouring words. Features are its length, its character transitions (changes
of class, and pairs of letters usual in words), the share of it that dictionary words
cover, whether it looks like a path or a placeholder, and name and neighbouring words.
A forest of small trees, fitted in numpy on the driver from the labelled findings below
(a fixed, seeded set of FINDINGS rows), becomes SQL CASE expressions that are evaluated
within the row: no shuffle, no Python worker.

A candidate is a secret if the mean of the trees' shares is at least 0.5. In
``redact`` a text is cut once at its candidates, and MASK takes the place of every
candidate that is a secret by itself or equal to one of the text's secrets, so the time
is linear in the text also where it lists many keys. Null texts have no candidates and
stay null, empty ones stay empty, an empty table gives an empty one; repeated secrets of
a text are listed once; repeated rows each give a row; ties (exactly 0.5) count as
secrets. Very long texts are handled whole, within their row. Input columns named as an
output are replaced.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = "<secret>"
FINDINGS, TREES, DEPTH = 8000, 15, 6
_SIGN = "[\"']?[ \t]{0,3}(?::=|=>|[:=])[ \t]{0,3}"
_SECRET = "(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]ass|PASS|[Pp]wd|PWD|[Aa][Pp][Ii][_.-]?[Kk][Ee][Yy]|[Aa]uth(?!or)|AUTH(?!OR)|[Cc]redential|CREDENTIAL|[Pp]rivate[_.-]?[Kk]ey|PRIVATE_KEY|[Aa]ccess[_.-]?[Kk]ey|ACCESS_KEY|[Bb]earer|BEARER)"
_WHITE = " \t\n\r\f\x0b"
#: Forms of issued keys. Fixed values.
_KEYS = "(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,255}|xox[abprs]-[A-Za-z0-9-]{10,200}|AIza[A-Za-z0-9_-]{30,60}|sk_live_[A-Za-z0-9]{16,100}|sk-[A-Za-z0-9]{20,100}|glpat-[A-Za-z0-9_-]{16,60}|eyJ[A-Za-z0-9_-]{10,}(?:[.][A-Za-z0-9_-]{4,}){1,2}"
TOKEN = "(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_-][A-Za-z0-9+/_=-]{11,}"
_ISSUED_OR_TOKEN = f"(?:(?:{_KEYS})(?![A-Za-z0-9+/_-])|{TOKEN})"
#: A name with a sign after it (looked for first, as few words have one) and its value, or an issued key or token alone.
CANDIDATE = (
    "(?<![A-Za-z0-9+/_=-])(?:(?=[A-Za-z0-9_.-]{2,75}+[\"']?[ \t]{0,3}[:=])"
    f"(?:[A-Za-z0-9_.-]{{0,30}}{_SECRET}[A-Za-z0-9_.-]{{0,20}}{_SIGN}(?:\"[^\"{_WHITE}]{{6,}}\"|'[^'{_WHITE}]{{6,}}'|[^\"'<>,;(){{}}\\[\\]{_WHITE}]{{6,}})"
    f"|[A-Za-z][A-Za-z0-9_.-]{{1,40}}{_SIGN}[\"']?{_ISSUED_OR_TOKEN})|{_ISSUED_OR_TOKEN})"
)
#: Up to two words at the end of what stands before a candidate, and at the beginning of what follows; so many characters of it are looked at.
BEFORE, AFTER, NEAR = "((?:[A-Za-z]{2,20}[ \t]{1,3}){0,2})$", "^((?:[\"' \t,.;)]{1,3}[A-Za-z]{2,20}){0,2})", 50
#: Words of identifiers, paths and prose that random strings do not have. Fixed values.
DICTIONARY = "example|sample|placeholder|changeme|default|dummy|secret|password|token|build|version|release|commit|image|static|assets|index|archive|content|article|document|report|update|module|object|string|number|class|config|server|client|local|remote|public|source|target|output|input|data|file|path|page|user|name|test|demo|node|java|script|python|linux|http|https|www|com|org|html|json|year|month|date|time|line|item|list|part|from|with|that|this|tion|ment|ness|able"
#: Pairs of letters that are usual in words. Fixed values.
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt"
CHANGES = "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
SECRET_NAME = "(?i)token|secret|passw|pass$|pwd|api.?key|auth(?!or)|credential|private|access.?key|bearer"
PLAIN_NAME = "(?i)sha[0-9]*$|md5|commit|checksum|digest|hash|uuid|guid|version|build|rev|etag|integrity|phone|card|order|isbn|file|path|url|href|src|id$"
ISSUED = f"^(?:{_KEYS})$"
#: What stands for a value, or computes one. Fixed values.
STANDIN = "(?i)^[$%<{\\[]|[*x.#]{4,}|0{6,}|(?:^|[^a-z])(?:your|my|none|null|nil|true|false|undefined|required|optional|string|env|environ|getenv|getpass|process|config|settings|example|changeme|placeholder|redacted|hidden|empty)(?:[^a-z]|$)|[()]"
PARTS = f"^(?:([A-Za-z0-9_.-]+){_SIGN})?[\"']?([^{_WHITE}]*?)[\"']?$"
FEATURES = ("length", "digits", "letters", "changes", "pairs", "dictionary", "path", "secret_name", "plain_name", "issued", "hexadecimal", "upper", "marks", "standin", "secret_near", "plain_near")


def features(name: str, token: str, near: str = "") -> list[float]:
    """The features in Python, for fitting; _features() is the same in SQL. Near: the neighbouring words."""
    n = max(1, len(token))
    low = token.lower()
    return [
        float(len(token)),
        len(re.findall("[0-9]", token)) / n,
        len(re.findall("[A-Za-z]", token)) / n,
        len(re.findall(CHANGES, token)) / n,
        len(re.findall(PAIRS, low)) / n,
        (len(token) - len(re.sub(DICTIONARY, "", low))) / n,
        len(re.findall("/", token)) / n,
        float(bool(re.search(SECRET_NAME, name))),
        float(bool(re.search(PLAIN_NAME, name))),
        float(bool(re.search(ISSUED, token))),
        float(bool(re.search("^[0-9a-fA-F-]+$", token))),
        len(re.findall("[A-Z]", token)) / n,
        len(re.findall("[^A-Za-z0-9]", token)) / n,
        float(bool(re.search(STANDIN, token))),
        float(bool(re.search(NEAR_SECRET, near))),
        float(bool(re.search(NEAR_PLAIN, near))),
    ]


def _features(name, token, near):
    n = F.greatest(F.length(token), F.lit(1))
    low = F.lower(token)

    def flag(x):
        return x.cast("double")

    values = [
        F.length(token).cast("double"),
        F.regexp_count(token, F.lit("[0-9]")) / n,
        F.regexp_count(token, F.lit("[A-Za-z]")) / n,
        F.regexp_count(token, F.lit(CHANGES)) / n,
        F.regexp_count(low, F.lit(PAIRS)) / n,
        (F.length(token) - F.length(F.regexp_replace(low, DICTIONARY, ""))) / n,
        F.regexp_count(token, F.lit("/")) / n,
        flag(name.rlike(SECRET_NAME)),
        flag(name.rlike(PLAIN_NAME)),
        flag(token.rlike(ISSUED)),
        flag(token.rlike("^[0-9a-fA-F-]+$")),
        F.regexp_count(token, F.lit("[A-Z]")) / n,
        F.regexp_count(token, F.lit("[^A-Za-z0-9]")) / n,
        flag(token.rlike(STANDIN)),
        flag(near.rlike(NEAR_SECRET)),
        flag(near.rlike(NEAR_PLAIN)),
    ]
    return F.struct(token.alias("token"), *(v.alias(k) for k, v in zip(FEATURES, values, strict=True)))


#: Neighbouring words that speak of secrets, and of public values. Fixed values.
NEAR_SECRET = "(?i)(?:^|[^a-z])(?:key|keys|secret|secrets|token|password|passwords|credential|credentials|login|leaked|rotate|revoke|private|aws|bearer|auth)(?:[^a-z]|$)"
NEAR_PLAIN = "(?i)(?:^|[^a-z])(?:commit|checksum|digest|hash|version|build|revision|uuid|order|card|phone|isbn|file|path|image|release|tag|example|sample|placeholder|public)(?:[^a-z]|$)"


def findings(n: int = FINDINGS, seed: int = 31) -> list[tuple[str, str, str, int]]:
    """Labelled findings (name, token, neighbouring words, is_secret), made from a seed."""
    r = random.Random(seed)
    hexa, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    lower = base[26:52]

    def some(alphabet: str, k: int) -> str:
        return "".join(r.choice(alphabet) for _ in range(k))

    def digit(t: str) -> str:
        return t if any(c.isdigit() for c in t) else t[:-1] + r.choice("0123456789")

    def spoken() -> str:
        """A word that can be said, as prose has and dictionaries do not."""
        return "".join(r.choice("bcdfghklmnprstvw") + r.choice(["a", "e", "i", "o", "u", "er", "an", "in", "ti"]) for _ in range(r.randint(2, 4)))

    words = DICTIONARY.split("|")
    names = ["token", "TOKEN", "password", "PASSWORD", "secret", "api_key", "apiKey", "auth_token", "passwd", "db_password", "DB_PASS", "access_key", "client_secret", "private_key", "credential", "bearer", "pwd"]
    plain = ["sha256", "md5", "commit", "checksum", "digest", "hash", "uuid", "version", "build", "etag", "integrity", "order", "card", "phone", "file", "path", "url", "id", "rev", "isbn"]
    secret_words = ["the aws key", "leaked", "rotate this secret", "private", "login", "my token"]
    plain_words = ["see commit", "the checksum", "order", "card", "an example", "build", "file hash"]
    stand = ["required", "optional", "string", "null", "undefined", "changeme", "process.env.TOKEN", "os.environ", "getpass.getpass", "config.secret", "settings.PASSWORD", "${SECRET}", "$PASSWORD", "%TOKEN%", "********", "xxxxxxxx", "your-password", "your_api_key", "YOUR_TOKEN_HERE", "<password>", "example_token", "disabled", "basic", "authentication", "expired", "missing"]
    marks = "!@#$%^&*-_+=?"
    out = []
    while len(out) < n:
        kind = r.randrange(22)
        name, none = r.choice(names), r.random() < 0.3
        about = " ".join(spoken() for _ in range(r.randint(0, 4)))
        if r.random() < 0.15:
            about = r.choice(secret_words) + " " + about
        if kind == 0:
            found = (name, digit(some(hexa, r.choice([16, 18, 20, 24, 32, 40, 64]))), 1)
        elif kind == 1:
            found = (name, digit(some(base, r.randint(12, 48))), 1)
        elif kind == 2:
            found = ("" if none else r.choice([*names, "key", "aws"]), "AKIA" + some(base[:26] + "234567", 16), 1)
        elif kind == 3:
            found = ("" if none else r.choice([*names, "key", "github"]), "ghp_" + some(base, 36), 1)
        elif kind == 4:
            found = (name, digit(some(base + "+/_-", r.randint(20, 64))), 1)
        elif kind == 5:
            found = ("" if none else name, r.choice(["sk_live_", "xoxb-", "sk-"]) + some(base, r.randint(24, 40)), 1)
        elif kind == 6:
            found = (r.choice(plain), digit(some(hexa, r.choice([16, 32, 40, 64]))), 0)
        elif kind == 7:
            found = ("" if none else r.choice(plain), "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), 0)
        elif kind == 8:
            found = ("" if none else r.choice(plain), some("0123456789", r.randint(12, 19)), 0)
        elif kind == 9:
            found = ("" if r.random() < 0.6 else r.choice(plain), "/".join(r.choice(words) for _ in range(r.randint(2, 5))) + "/" + some("0123456789", r.randint(1, 5)), 0)
        elif kind == 10:
            found = (r.choice([*names, *plain, ""]), r.choice("_-").join(r.choice(words) for _ in range(r.randint(2, 5))) + some("0123456789", r.randint(1, 4)), 0)
        elif kind == 11:
            found = (name, r.choice(["your", "my", "xxxx", "0000", "1234", "example", "placeholder", "changeme"]) + "_" + r.choice(words) + "_" + r.choice(words) + r.choice("0123456789"), 0)
        elif kind == 12:
            found = ("", digit(some(hexa, r.choice([16, 20, 32, 40, 64]))), 0)
            about = r.choice(plain_words) if r.random() < 0.5 else " ".join(spoken() for _ in range(2))
        elif kind == 13:
            found = ("", some(lower, r.randint(10, 20)) + some("0123456789", r.randint(1, 3)), 0)
        elif kind == 14:  # a phrase as a password
            found = (name, "".join(spoken() for _ in range(r.randint(3, 5))) + r.choice(["", "", some("0123456789", 2)]), 1)
        elif kind == 15:  # letters of any kind, no digit
            found = (name, some(r.choice([lower, base[:52]]), r.randint(14, 40)), 1)
        elif kind == 16:  # with punctuation
            t = list(some(base, r.randint(6, 16)))
            for _ in range(r.randint(1, 3)):
                t[r.randrange(len(t))] = r.choice(marks)
            found = (name, "".join(t), 1)
        elif kind == 17:  # a word with a few digits
            found = (r.choice(["password", "passwd", "pwd", "DB_PASS", "db_password"]), spoken()[:8] + some("0123456789", r.randint(1, 4)), 1)
        elif kind == 18:
            found = (name, r.choice(stand), 0)
        elif kind == 19:  # prose after a colon
            word = spoken()[:11]
            found = (name, r.choice([word, word, word.capitalize()]) + r.choice(["", ".", "!"]), 0)
        elif kind == 20:
            found = ("" if none else name, r.choice(words) + r.choice(["", ".", "_"]) + r.choice(words) + r.choice(["", "s", "ed"]), 0)
        else:  # a key without a name, but with words that tell
            found = ("", digit(some(r.choice([hexa, base]), r.choice([32, 40, 48]))), 1)
            about = r.choice(secret_words)
        out.append((found[0], found[1], about.strip(), found[2]))
    return out


def _tree(x: np.ndarray, y: np.ndarray, r: np.random.Generator, depth: int):
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 10:
        return share
    best = None
    for f in r.choice(x.shape[1], 7, replace=False):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 19))):
            left = x[:, f] <= cut
            k = left.sum()
            if 0 < k < len(y):
                p, q = y[left].mean(), y[~left].mean()
                impurity = k * p * (1 - p) + (len(y) - k) * q * (1 - q)
                if best is None or impurity < best[0]:
                    best = (impurity, int(f), float(cut), left)
    if best is None:
        return share
    _, f, cut, left = best
    return f, cut, _tree(x[left], y[left], r, depth - 1), _tree(x[~left], y[~left], r, depth - 1)


@lru_cache(maxsize=4)
def forest(n: int = FINDINGS, seed: int = 31) -> tuple:
    """Trees as nested (feature, cut, at most, above), leaves as shares of secrets."""
    rows = findings(n, seed)
    x = np.array([features(*row[:3]) for row in rows])
    y = np.array([row[3] for row in rows], float)
    r = np.random.default_rng(seed)
    return tuple(_tree(x[i], y[i], r, DEPTH) for i in (r.integers(0, len(y), len(y)) for _ in range(TREES)))


def probability(name: str, token: str, near: str = "") -> float:
    x = features(name, token, near)

    def walk(t):
        while not isinstance(t, float):
            t = t[2] if x[t[0]] <= t[1] else t[3]
        return t

    return sum(walk(t) for t in forest()) / TREES


def _case(tree, row):
    if isinstance(tree, float):
        return F.lit(tree)
    f, cut, low, high = tree
    return F.when(row[FEATURES[f]] <= cut, _case(low, row)).otherwise(_case(high, row))


def _parts(own, near):
    """Features of a candidate, its name and token, and the words beside it."""
    return _features(F.regexp_extract(own, PARTS, 1), F.regexp_extract(own, PARTS, 2), near)


def _vote(row):
    total = None
    for tree in forest():
        v = _case(tree, row)
        total = v if total is None else total + v
    return total / TREES >= 0.5


def _scanned(docs: DataFrame, text: str) -> DataFrame:
    """docs with __between, the text cut at its candidates, and __found: candidates, their
    tokens, and whether they are secrets by themselves. Texts without candidates are not cut."""
    some, none = F.coalesce(F.col(text).rlike(CANDIDATE), F.lit(False)), F.array().cast("array<string>")
    docs = docs.withColumns({"__own": F.when(some, F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), F.lit(1))).otherwise(none), "__between": F.when(some, F.split(F.col(text), CANDIDATE, -1)).otherwise(none)})
    before = F.transform("__between", lambda x: F.regexp_extract(F.substring(x, -NEAR, NEAR), BEFORE, 1))
    after = F.transform(F.slice("__between", 2, F.greatest(F.size("__own"), F.lit(1))), lambda x: F.regexp_extract(F.substring(x, 1, NEAR), AFTER, 1))
    near = F.zip_with(F.slice(before, 1, F.size("__own")), after, lambda a, b: F.concat_ws(" ", a, b))
    judged = F.transform(F.zip_with("__own", near, _parts), lambda row: F.struct(row["token"].alias("token"), _vote(row).alias("secret")))
    return docs.withColumn("__found", F.zip_with("__own", judged, lambda own, j: F.struct(own.alias("own"), j["token"].alias("token"), j["secret"].alias("secret")))).drop("__own")


def _listed(docs: DataFrame) -> DataFrame:
    secrets = F.array_distinct(F.transform(F.filter("__found", lambda f: f["secret"]), lambda f: f["token"]))
    return docs.withColumns({"secrets": secrets, "n_candidates": F.size("__found").cast("long")})


def scan(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with n_candidates and secrets, the distinct secret strings of a text in order."""
    return _listed(_scanned(docs.drop("n_candidates", "secrets"), text)).drop("__found", "__between")


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """scan() with MASK in the text in the place of its secrets."""
    out = _listed(_scanned(docs.drop("n_candidates", "secrets"), text))
    masked = F.transform("__found", lambda f: F.when(f["secret"] | F.array_contains(F.col("secrets"), f["token"]), F.replace(f["own"], f["token"], F.lit(MASK))).otherwise(f["own"]))
    clean = F.concat_ws("", F.flatten(F.zip_with("__between", masked, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))
    return out.withColumn(text, F.when(F.size("secrets") > 0, clean).otherwise(F.col(text))).drop("__found", "__between")


def report(docs: DataFrame) -> DataFrame:
    return redact(docs.select("doc_id", "text")).select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), "secrets", F.sha2("text", 256).alias("redacted_sha256"))


def brute(text: str | None) -> tuple[int, list[str], str | None]:
    """(n_candidates, secrets, redacted text) in Python, for tests."""
    if text is None:
        return 0, [], None
    found, between = [], re.split(CANDIDATE, text)
    for k, m in enumerate(re.finditer(CANDIDATE, text)):
        name, token = re.search(PARTS, m[0]).groups()
        near = f"{re.search(BEFORE, between[k][-NEAR:])[1]} {re.search(AFTER, between[k + 1][:NEAR])[1]}"
        found.append((m[0], token, probability(name or "", token, near) >= 0.5))
    secrets = list(dict.fromkeys(t for _, t, s in found if s))
    out = [between[0]]
    for (own, token, _), rest in zip(found, between[1:], strict=True):
        out += [own.replace(token, MASK) if token in secrets else own, rest]
    return len(found), secrets, "".join(out)


def digest(text: str | None) -> str | None:
    return None if text is None else hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
