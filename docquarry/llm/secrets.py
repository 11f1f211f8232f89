"""Secret scans: candidates by shape, a random forest to remove false positives, in SQL functions only.

A text is cut into runs of value characters (letters and digits of ASCII, + / _ -) and runs of others; the runs joined
are the text. A value run of 12 characters or more is a candidate if it has a digit or begins like an issuer's key. Next to
a word that names a secret, with an assignment or a blank between, what stands there up to white space or its closing quote
is one run and a candidate from NEAREST characters on, whatever they are. So are the password in a URL, a private key
block in PEM form, and a web token of two or three parts, each as a whole. The forest sees a candidate's length, character
transitions, how much of it words of the dictionary cover, whether it lies in a path, and the words next to it.

The dictionary is the corpus' own: the WORDS words that most documents have, with the COMMON ones; only these reach the
driver. The forest is fitted there from labelled findings, which are generated from a seed (FINDINGS of them) if none are
given, and is written out as one SQL expression. Everything a text needs stays in its row: there is no join and no shuffle.

Null texts have no findings and stay null; repeated values and rows are found each time; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import forest
from docquarry.llm.shared import renamed

#: Labelled findings a fit takes, and the share of trees' votes from which a candidate counts as a secret.
FINDINGS, SURE = 4000, 0.5
#: Words of the corpus that the dictionary holds.
WORDS = 2000
MASK = "[SECRET]"
# Words that name a secret, words that name a digest or an identifier, words of placeholders and tests,
# prefixes of issuers' keys, and common words for the dictionary coverage.
SECRET_WORDS = "password passwd pwd passphrase token secret apikey api_key api-key accesskey access_key auth authorization bearer credential credentials private_key client_secret key pass contraseña contrasena clave passwort kennwort mot_de_passe motdepasse senha".split()
DIGEST_WORDS = "sha sha1 sha256 sha512 md5 commit checksum digest etag uuid guid hash revision rev blob tree object id ref version build integrity fingerprint isbn order invoice phone card account".split()
DUMMY_WORDS = "example sample dummy placeholder changeme your test fake mock fixture xxxx todo insert replace redacted demo foobar".split()
PREFIXES = "AKIA ASIA ghp_ gho_ ghs_ github_pat_ glpat- xoxb- xoxp- sk- sk_live_ rk_live_ AIza ya29 eyJ npm_ pypi- hf_ SG".split()
COMMON = "the and for with from this that have not are was you all can has had will one our out day get use man new now way may say she her him his how its let put too old see two who did yes data file name user test main page index list item node link view text time date type code base path home lib src app api web site html http https www com org net image img static assets config build dist module package version release branch master feature document article section chapter report order number customer product service server client request response function class object value string array table column query result error message".split()
# what stands beside a word that names a secret and is none
PLAIN_VALUES = "required optional string value text none null true false undefined basic bearer digest default enabled disabled integer boolean invalid missing expired administrator authentication authorization configuration documentation should must will cannot with from that this they field name manager rotation policy length features words through".split()
#: Fewest characters of a value next to a word that names a secret.
NEAREST = 4
# In SQL strings: such a word, what lies between it and its value, and the value: up to the closing quote, or to white
# space, less closing punctuation; a comma, semicolon or ampersand ends it if an assignment follows.
_NAMED = r"(?i:(?<![A-Za-z0-9])(" + "|".join(SECRET_WORDS).replace("ñ", "[ñÑ]") + r")s?)"
_BETWEEN = r"[\\x22\\x27]?([ \\t](is|was|es|ist|est))?[ \\t]{0,4}([=:]{1,3}>?[ \\t]{0,4}[\\x22\\x27]?|[ \\t])"
# characters of a value, punctuation that isn't its end, and signs after which another assignment would end it; possessive
# all, so values of any length take linear time and no stack
_CORE, _INNER = r"[^\\s\\x22\\x27<>,;&.:)}\\]]", r"[.:)}\\]]"
_SIGN = r"[,;&](?![A-Za-z_.\\-]{0,40}=)(?=" + _INNER + r"*+" + _CORE + r")"
_VALUE = r"(?!\\[SECRET\\]|[\\s=:\\x22\\x27])((?<=[\\x22\\x27])[^\\x22\\x27\\r\\n]{4,}+(?=[\\x22\\x27])|(?=[^\\s\\x22\\x27<>]{4})(?:" + _CORE + r"++|" + _INNER + r"++(?=" + _CORE + r"|" + _SIGN + r")|" + _SIGN + r")++)"
_PEM = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=:,;.\\s]++(?:-[A-Za-z0-9+/=:,;.\\s]++)*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----"
_TOKEN = r"(?<![A-Za-z0-9+/_\\-])eyJ[A-Za-z0-9_\\-]{5,}(\\.[A-Za-z0-9_\\-]{5,}){1,2}"
# a look-behind must be bounded, so a user in a URL has 64 characters at most
_USER, _IN_URL = r"://[^\\s/:@]{1,64}:", r"[^\\s/@]{4,}+"
RUNS = rf"{_PEM}|(?<={_NAMED}{_BETWEEN}){_VALUE}|(?<={_USER}){_IN_URL}(?=@)|{_TOKEN}|[A-Za-z0-9+/_\\-]+|(?<={_NAMED}){_BETWEEN}(?={_VALUE})|[^A-Za-z0-9+/_\\-]+"
#: A run of 12 or more with a digit or an issuer's prefix; tried where a run begins only, so long runs take linear time.
_STARTS = "(" + "|".join(PREFIXES) + ")"
LIKELY = rf"(?<![A-Za-z0-9+/_\\-])(?=[A-Za-z+/_\\-]*+[0-9]|{_STARTS})[A-Za-z0-9+/_\\-]{{12}}|{_NAMED}{_BETWEEN}{_VALUE}|-----BEGIN [A-Z0-9 ]{{0,40}}PRIVATE KEY|{_USER}{_IN_URL}@"
FEATURES = ["n_chars", "transitions", "distinct_share", "digit_share", "upper_share", "is_hex", "covered", "vowel_share", "path_like", "secret_word", "digest_word", "assigned", "prefixed", "dummy", "dummy_near", "path_dummy", "equals", "symbol_share", "letters_only", "filled_in", "key_block", "in_url"]


def _any(words: list[str]) -> str:
    return "(" + "|".join(w.strip() for w in words) + ")"

def _before(runs: str, i: str) -> str:
    """SQL of the text of the six runs before a run."""
    return f"array_join(slice({runs}, greatest({i} - 6, 0) + 1, least({i}, 6)), '')"


def _is_long(v: str) -> str:
    """SQL that is true for a run of 12 or more with a digit or an issuer's prefix."""
    return rf"(length({v}) >= 12 and {v} rlike '[0-9]|^{_STARTS}' and {v} rlike '^[A-Za-z0-9+/_\\-]')"


def _is_named(v: str, before: str) -> str:
    """SQL that is true for a run beside a word that names a secret."""
    shape = _VALUE.replace(r"(?<=[\\x22\\x27])", "").replace(r"(?=[\\x22\\x27])", "")
    return f"(length({v}) >= {NEAREST} and {before} rlike '{_NAMED}{_BETWEEN}$' and {v} rlike '^{shape}$')"


def _in_url(v: str, before: str, after: str) -> str:
    """SQL that is true for the password in a URL."""
    return f"(startswith({after}, '@') and {before} rlike '{_USER}$' and {v} rlike '^{_IN_URL}$')"


def trie(words: list[str]) -> str:
    """A regular expression of any of the words, all letters, branching letter by letter; the longest is taken."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def branch(node: dict) -> str:
        ways = [c + branch(node[c]) for c in sorted(node) if c]
        inner = "" if not ways else ways[0] if len(ways) == 1 and "" not in node else "(?:" + "|".join(ways) + ")"
        return inner + "?" if ways and "" in node else inner

    return branch(tree)


def vocabulary(df: DataFrame, *, text_col: str = "text", most: int = WORDS) -> tuple[str, ...]:
    """The words of 4 to 16 letters that most rows of df have, `most` at most, and the COMMON ones, in alphabetical order."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit(r"(?<![\p{L}0-9])\p{L}{4,16}(?![\p{L}0-9])"), F.lit(0)))
    rows = df.select(F.explode(found).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(most).collect()
    return tuple(sorted({r.w for r in rows} | set(COMMON)))


def _candidate(runs: str, i: str, path: str, words: str) -> str:
    """SQL of the struct of a candidate: place, value and features. runs: an array of strings, i: its index, words: the
    dictionary as a regular expression."""
    v, at = f"{runs}[{i}]", lambda k: f"lower(coalesce(get({runs}, {i} + {k}), ''))"
    sep, word, more, after = at(-1), at(-2), at(-4), at(2)
    low = f"lower({v})"
    share = lambda what: f"(length({v}) - length(regexp_replace({v}, '{what}', ''))) / length({v})"
    kinds = f"regexp_replace(regexp_replace(regexp_replace({v}, '[a-z]', 'a'), '[A-Z]', 'A'), '[0-9]', '0')"
    one = lambda test: f"CAST(CASE WHEN {test} THEN 1 ELSE 0 END AS DOUBLE)"
    near, before = f"concat_ws(' ', {more}, {word}, {after})", _before(runs, i)
    columns = {
        "n_chars": f"CAST(length({v}) AS DOUBLE)",
        "transitions": f"(length(regexp_replace({kinds}, '(.)\\\\1+', '$1')) - 1) / (length({v}) - 1)",
        "distinct_share": f"size(array_distinct(split({v}, ''))) / length({v})",
        "digit_share": share("[0-9]"),
        "upper_share": share("[A-Z]"),
        "is_hex": one(f"{v} rlike '^([0-9a-f]+|[0-9A-F]+)$' and {v} rlike '[a-fA-F]'"),
        "covered": f"(length({low}) - length(regexp_replace({low}, '{words}', ''))) / length({v})",
        "vowel_share": share("[aeiouAEIOU]"),
        "path_like": one(f"{v} rlike '/.*/|^/' or {sep} rlike '://|[.]$|[?&#%]$'"),
        "secret_word": one(f"{word} rlike '(^|[_-]){_any(SECRET_WORDS)}s?$' or {before} rlike '{_NAMED}{_BETWEEN}$'"),
        "digest_word": one(f"{word} rlike '(^|[_-]){_any(DIGEST_WORDS)}$'"),
        "assigned": one(f"{sep} rlike '[=:]'"),
        "prefixed": one(f"{v} rlike '^{_any(PREFIXES)}'"),
        "dummy": one(f"{low} rlike '{_any(DUMMY_WORDS)}'"),
        "dummy_near": one(f"{near} rlike '{_any(DUMMY_WORDS)}'"),
        "equals": one(f"{sep} rlike '='"),
        "symbol_share": share("[^A-Za-z0-9]"),
        "letters_only": one(f"{v} rlike '^[A-Za-z]+$'"),
        "filled_in": one(f"{v} rlike '^[$%{{(\\\\[*]|[(].*[)]$|[}}\\\\]]$'"),
        "key_block": one(f"startswith({v}, '-----BEGIN')"),
        "in_url": one(_in_url(v, before, f"coalesce(get({runs}, {i} + 1), '')")),
        "path_dummy": one(f"lower(coalesce({path}, '')) rlike '{_any(DUMMY_WORDS)}'"),
    }
    return f"named_struct('run_no', {i}, 'value', {v}, 'near', {word}, " + ", ".join(f"'{k}', {columns[k]}" for k in FEATURES) + ")"


def _is_candidate(runs: str, i: str) -> str:
    """SQL that is true for a run that is a candidate."""
    v, before = f"{runs}[{i}]", _before(runs, i)
    # most runs fail the first two conditions, and only then are those before them joined
    return f"({_is_long(v)} or (length({v}) >= {NEAREST} and ({_is_named(v, before)} or {_in_url(v, before, f"coalesce(get({runs}, {i} + 1), '')")})))"


def candidates(text: str, path: str = "CAST(NULL AS STRING)", words: tuple[str, ...] = tuple(COMMON)) -> str:
    """SQL of an array of candidate structs of a text column; the runs are cut once and bound to a name."""
    places = f"filter(sequence(0, size(q__r) - 1), q__i -> {_is_candidate('q__r', 'q__i')})"
    found = f"transform({places}, q__i -> {_candidate('q__r', 'q__i', path, trie(words))})"
    return f"CASE WHEN {text} rlike '{LIKELY}' THEN transform(array(regexp_extract_all({text}, '{RUNS}', 0)), q__r -> {found})[0] END"


def labelled(n: int = FINDINGS, seed: int = 11, words: tuple[str, ...] = tuple(COMMON)) -> list[tuple[str, str, int]]:
    """Texts with one finding each, the path they lie in, and whether it is a secret. words: those of the dictionary."""
    rng = random.Random(seed)
    pick, chars = rng.choice, lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    hexes, lower, upper, digits = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    mixed = lower + upper + digits
    noun = lambda: "".join(pick(lower) for _ in range(rng.randint(2, 7)))
    filler = lambda: " ".join(pick([noun(), noun(), pick(words)]) for _ in range(rng.randint(1, 6)))
    digit = lambda s: s if any(c.isdigit() for c in s) else s[:-1] + pick(digits)
    random_value = lambda: digit(pick([chars(hexes, pick([16, 18, 20, 24, 32, 40, 48, 64])), chars(hexes, rng.randint(12, 40)), chars(hexes, 40).upper(), chars(mixed, rng.randint(12, 44)), chars(mixed + "+/", rng.randint(20, 60)), chars(mixed + "_-", rng.randint(20, 50))]))
    key = lambda: pick([pick(SECRET_WORDS), pick(SECRET_WORDS), pick(["db_", "aws_", "my-", "user_"]) + pick(SECRET_WORDS)])
    assign = lambda: pick(["=", " = ", ": ", '="', ' = "', ': "', "='", '": "', ":"])
    styled = lambda k: pick([k, k, k.upper(), k.title()])

    syllables = lambda a, b: "".join(pick("bcdfglmnprst") + pick("aeiou") + pick(["", "", "n", "r", "s", "t"]) for _ in range(rng.randint(a, b)))
    near = lambda: pick(["=", "=", " = ", ": ", ":", '="', ": '", '": "'])

    def named() -> str:
        kind, quote = rng.randrange(6), near()
        if kind == 0:
            value = chars(mixed, rng.randint(4, 9)) + pick("!@#$%^*.?-_") + chars(mixed + "!@#$%.", rng.randint(0, 8))
        elif kind == 1:
            value = pick([syllables(2, 3), pick(words)]) + chars(digits, rng.randint(1, 4)) + pick(["", "!", "!x", "@", "#", "."]) + chars(mixed, rng.randint(0, 3))
        elif kind == 2:
            value = chars(lower + upper, rng.randint(8, 40))
        elif kind == 3:
            value = pick([chars(lower, rng.randint(14, 32)), chars(mixed, rng.randint(8, 11)), chars(hexes, rng.randint(8, 11))])
        elif kind == 4:
            value = pick(["", "", "-", ".", "_"]).join(pick([syllables(2, 3), noun() + pick("aeiou")]) for _ in range(rng.randint(4, 6)))
        else:
            quote, value = pick(['="', ' = "', ': "', '": "']), " ".join(syllables(2, 3) for _ in range(rng.randint(4, 6)))
        if kind < 2 and rng.random() < 0.3:
            quote = pick([" ", " is ", " is: ", " was "])
        return f"{filler()} {styled(key())}{quote}{value}{pick(quote[-1]) if quote[-1] in chr(34) + chr(39) else ''} {filler()}"

    def unnamed() -> str:
        plain = lambda: pick([syllables(1, 4), pick(words), pick(PLAIN_VALUES)])
        word = pick([lambda: plain(), lambda: plain().title(), lambda: pick(PLAIN_VALUES)])()
        word = word if len(word) >= NEAREST else pick(PLAIN_VALUES)
        kind = rng.randrange(5)
        if kind == 0:
            return f"{filler()} {styled(key())} {pick(['', '', 'is ', 'is: ', 'was '])}{word} {filler()}"
        if kind == 1:
            return f"{filler()} {styled(key())}{pick([': ', ': ', ':'])}{word} {filler()}"
        if kind == 2:
            return f"{styled(key())}{near().rstrip(chr(34) + chr(39))}{pick(PLAIN_VALUES)} {filler()}"
        if kind == 3:
            name = pick([pick(SECRET_WORDS).upper(), "DB_" + pick(SECRET_WORDS).upper(), pick(SECRET_WORDS)])
            return f"{styled(key())}{near().rstrip(chr(34) + chr(39))}{pick(['${%s}', '$%s', '{{%s}}', '%%%s%%', 'getenv(%s)', 'os.environ[%s]', 'config(%s)', '[%s]', '****%s']) % name} {filler()}"
        return f"{styled(key())}: https://{noun()}.com/{syllables(1, 3)}/{pick(words)} {filler()}"

    def block() -> str:
        """A private key, a password in a URL or a token of parts."""
        kind = rng.randrange(3)
        if kind == 0:
            what = pick(["RSA ", "EC ", "", "OPENSSH ", "DSA "])
            lines = "\n".join(chars(mixed + "+/", 64) for _ in range(rng.randint(2, 20)))
            return f"{filler()}\n-----BEGIN {what}PRIVATE KEY-----\n{lines}\n{chars(mixed, 20)}==\n-----END {what}PRIVATE KEY-----\n{filler()}"
        if kind == 1:
            value = pick([chars(mixed, rng.randint(6, 20)), syllables(2, 3) + chars(digits, 3), chars(mixed + "!$%^*.-_", rng.randint(8, 20))])
            return f"{filler()} {pick(['postgres', 'mysql', 'https', 'redis', 'amqp', 'mongodb'])}://{pick([noun(), 'admin', 'root', ''])or 'app'}:{value}@{noun()}.{pick(['com', 'local', 'net'])}:{rng.randint(1000, 9999)}/{noun()}"
        part = lambda k: chars(mixed + "_-", k)
        return f"{filler()} {pick(['', 'bearer ', 'token='])}eyJ{part(rng.randint(20, 40))}.eyJ{part(rng.randint(30, 90))}.{part(rng.randint(30, 60))} {filler()}"

    def secret() -> str:
        if rng.random() < 0.15:
            return block()
        if rng.random() < 0.35:
            return named()
        if rng.random() < 0.4:
            kind = rng.randrange(5)
            body = [pick(["AKIA", "ASIA"]) + chars(upper + digits, 16), pick(["ghp_", "gho_", "ghs_"]) + chars(mixed, 36), pick(["sk_live_", "rk_live_"]) + chars(mixed, 24), "AIza" + chars(mixed + "_-", 35), pick(["glpat-", "hf_", "npm_"]) + chars(mixed, pick([20, 34, 36]))][kind]
            return pick([f"{filler()} {body} {filler()}", f"{key()}{assign()}{body}\n{filler()}"])
        return f"{filler()} {styled(key())}{assign()}{random_value()}{pick(['', chr(34), chr(39)])} {filler()}"

    def other() -> str:
        if rng.random() < 0.3:
            return unnamed()
        kind = rng.randrange(9)
        if kind == 0:
            return f"{filler()} {pick(DIGEST_WORDS)}{pick([' ', ': ', '=', ':', ' = '])}{digit(chars(hexes, pick([32, 40, 64])))} {filler()}"
        if kind == 1:
            return f"{filler()} {'-'.join(chars(hexes, k) for k in (8, 4, 4, 4, 12))} {filler()}"
        if kind == 2:
            return f"{filler()} {chars(digits, rng.randint(12, 19))} {filler()}"
        if kind == 3:
            return f"{pick(['https://www.', 'see ', ''])}{noun()}.com/{'/'.join(pick([noun(), pick(words)]) for _ in range(rng.randint(2, 5)))}/{pick([noun(), chars(digits, 4)])}{pick(digits)} {filler()}"
        if kind == 4:
            return f"{styled(key())}{assign()}{pick(DUMMY_WORDS)}{pick(['_', '-', ''])}{pick(SECRET_WORDS)}{pick(['_here', '123', '1234', '-0000'])}{pick(digits)} {filler()}"
        if kind == 5:
            return f"{filler()} {pick(['_', '-']).join(pick([noun(), pick(words)]) for _ in range(rng.randint(3, 5)))}{pick(['_', '-'])}{rng.randint(1, 2024)} {filler()}"
        if kind == 6:
            return f"{filler()} {''.join(pick(words).title() for _ in range(4))}{rng.randint(1, 99)} {filler()}"
        if kind == 7:
            return f"{key()}{assign()}{pick('xX0*a1') * rng.randint(12, 30)}0 {filler()}"
        return f"{filler()} {random_value()} {filler()}" if rng.random() < 0.5 else f"for example {key()}{assign()}{random_value()} {filler()}"

    paths = ["src/main.py", "config/app.yaml", "src0", "notes", "deploy/env", "tests/fixtures/sample.py", "docs/example.md"]
    out = []
    for i in range(n):
        yes = i % 2
        out.append((secret() if yes else other(), pick(paths[:5] if yes or rng.random() < 0.6 else paths[5:]), yes))
    return out


def features_of(spark: SparkSession, rows: list[tuple[str, str, int]], words: tuple[str, ...] = tuple(COMMON)) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the findings of labelled texts, by the same SQL that scans documents."""
    made = spark.createDataFrame(rows, "text string, path string, y int").coalesce(1)
    got = made.select("y", F.explode(F.expr(candidates("text", "path", words))).alias("c")).select("y", *(f"c.{f}" for f in FEATURES)).collect()
    data = np.array([tuple(r) for r in got], dtype=float).reshape(-1, len(FEATURES) + 1)
    return data[:, 1:], data[:, 0]


@functools.lru_cache(maxsize=4)
def _fitted(findings: tuple, words: tuple[str, ...], ref: str, spark: SparkSession) -> str:
    x, y = features_of(spark, list(findings), words)
    return forest.to_sql(forest.fit(x, y, FEATURES), FEATURES, ref)


def _score(df: DataFrame, text_col: str, findings: list | None, words: tuple[str, ...] | None) -> tuple[str, tuple[str, ...]]:
    """SQL of the forest's score of the struct q__c, and the dictionary: that of df if none is given."""
    words = vocabulary(df, text_col=text_col) if words is None else tuple(words)
    return _fitted(tuple(findings or labelled(words=words)), words, "q__c.", df.sparkSession), words


def scanned(df: DataFrame, *, text_col: str = "text", path_col: str | None = None, findings: list | None = None, words: tuple[str, ...] | None = None, into: str = "_findings") -> DataFrame:
    """df with a column `into`: an array of structs with run_no, value, near, the FEATURES and score; null if there are none.

    findings: labelled texts as (text, path, 0 or 1), up to some thousands; else those of labelled(). words: the dictionary,
    else that of df. A column of df that is called as `into` is refused."""
    if into in df.columns:
        raise ValueError(f"the table has a column {into}")
    score, words = _score(df, text_col, findings, words)
    found = candidates(f"`{text_col}`", f"`{path_col}`" if path_col else "CAST(NULL AS STRING)", words)
    fields = ", ".join(f"'{k}', q__c.{k}" for k in ("run_no", "value", "near", *FEATURES))
    return df.withColumn(into, F.expr(f"transform({found}, q__c -> named_struct({fields}, 'score', round({score}, 9)))"))


def report(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", **options) -> DataFrame:
    """One row per candidate: id, run_no (which run of the text it is), n_chars, value_sha256, near_word, score, is_secret.

    Values are given by their SHA-256 sums only. options: findings and words, as in scanned()."""
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), (F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")).alias("path"))
    rows = scanned(own, path_col="path", **options).select(F.col("id").alias(id_col), F.explode("_findings").alias("c"))
    return rows.select(id_col, "c.run_no", F.col("c.n_chars").cast("int").alias("n_chars"), F.sha2("c.value", 256).alias("value_sha256"), F.col("c.near").alias("near_word"), F.col("c.score").alias("score"), (F.col("c.score") >= SURE).alias("is_secret"))


def redacted(df: DataFrame, *, text_col: str = "text", path_col: str | None = "source", count_col: str | None = None, findings: list | None = None, words: tuple[str, ...] | None = None) -> DataFrame:
    """df with every secret in the text replaced by MASK; columns and other texts as before.

    count_col: a column that gets the characters of a changed text, if df has it. findings, words: as in scanned()."""
    own, c = renamed(df)
    score, words = _score(own, c[text_col], findings, words)
    text, path = c[text_col], f"CAST({c[path_col]} AS STRING)" if path_col else "CAST(NULL AS STRING)"
    run = "q__r[q__i]"
    sure = f"transform(array({_candidate('q__r', 'q__i', path, trie(words))}), q__c -> {score})[0] >= {SURE}D"
    masked = f"transform(sequence(0, size(q__r) - 1), q__i -> CASE WHEN {_is_candidate('q__r', 'q__i')} THEN CASE WHEN {sure} THEN '{MASK}' ELSE {run} END ELSE {run} END)"
    out = own.withColumn("masked", F.expr(f"CASE WHEN {text} rlike '{LIKELY}' THEN transform(array(regexp_extract_all({text}, '{RUNS}', 0)), q__r -> array_join({masked}, ''))[0] ELSE {text} END"))
    if count_col in c:
        n = F.col(c[count_col])
        out = out.withColumn(c[count_col], F.when(F.col("masked").eqNullSafe(F.col(text)), n).otherwise(F.length("masked").cast(df.schema[count_col].dataType)))
    return out.withColumn(text, F.col("masked")).drop("masked").toDF(*df.columns)
