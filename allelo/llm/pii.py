"""Personal data and secrets replaced by surrogates of the same type and format (native DataFrame operations only).

Detected: e-mail addresses, secrets assigned to a name (token, password, key), access keys, IBANs, IP addresses, phone and
social security numbers, numbers of payment cards, and persons after a title: all words of the name, however many, and
every other mention of one of them in the same document (one-letter initials only after the title). Each entity, in a normal
form, gets a surrogate from a keyed hash: digits stay digits, letters letters of their case, punctuation and known prefixes
stay; IP octets stay in range with their number of digits; card numbers and IBAN-like codes keep their length, cards that
pass the Luhn check pass it again; the words of a person's name become invented names of the same script (Latin or
Cyrillic), case and gender. A name has the gender of the titles before it in most of its mentions in the corpus. The hash
depends on the entity alone, not on a title, so all mentions of one entity stay mentions of one (in whatever format), over
all documents.

Collision checks keep different entities different: all entities of the corpus are compared by surrogate, and all but one
of those that share it, or whose surrogate is itself an entity of the corpus, are hashed anew with the next number, until
none collides; e-mail addresses, IP octets, names and secrets get longer after some turns, and collisions that are left are
an error. Every text is searched once, and its pieces are stored; they only need to be joined with those few numbers.

Defined cases: null and empty texts stay; repeated rows get equal texts; text around entities is not changed; an empty
table gives an empty result; very long texts are searched whole. Other columns, of any name, pass through. A person who is
never named with a title is not found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KEY = "allelo surrogate key 1"
# Titles by gender.
MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа")
NEUTRAL = ("Dr", "Prof")
_TITLES = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
#: A word of a name; a possessive ending is not part of it.
_NAME = r"\p{Lu}\p{L}*+(?:[-'’](?!s(?!\p{L}))\p{L}++)*+(?:['’]s(?!\p{L}))?+"
_OWNER = r"['’]s$"
#: Type and pattern; the first that matches at a place wins. No pattern can start within a run that it would have to rescan.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"(?<![A-Za-z0-9])(?i:token|password|passwd|secret|api[_-]?key|access[_-]?key) ?[=:] ?[\"']?[A-Za-z0-9_+/.-]{6,}+[\"']?",
    "key": r"(?<![A-Za-z0-9])A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![A-Za-z0-9.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|\d{1,2})\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|\d{1,2})(?![A-Za-z0-9]|\.\d)",
    "phone": r"(?<![A-Za-z0-9+.-])(?:\+\d{1,3}[ .-]?|\d{1,3}[ .-])?(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?![A-Za-z0-9])|(?<![A-Za-z0-9+])\+\d{8,15}(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9-])",
    "card": r"(?<![A-Za-z0-9])\d(?:[ -]?\d){12,18}(?![A-Za-z0-9])",
    "person": rf"(?<!\p{{L}})(?:{_TITLES})\.? {_NAME}(?: {_NAME})*+",
}
#: First characters of the patterns that not every word can start; with these most places fail at once.
_FIRST = {"secret": "[tTpPsSaA]", "key": "A", "iban": "[A-Z]", "ip": "[0-9]", "phone": "[0-9+(]", "ssn": "[0-9]", "card": "[0-9]"}
_TITLE_FIRST = "[" + "".join(sorted({t[0] for t in MALE + FEMALE + NEUTRAL})) + "]"
#: All but persons start where no ASCII letter or digit stands before, so that is asked once for all of them.
ANY = (
    "(?<![A-Za-z0-9])(?:"
    + "|".join(f"(?={_FIRST[k]})(?:{p})" if k in _FIRST else f"(?:{p})" for k, p in PATTERNS.items() if k != "person")
    + f")|(?={_TITLE_FIRST})(?:{PATTERNS['person']})"
)
#: Texts without this have no entity.
HINT = rf"[0-9@=:{_TITLE_FIRST[1:]}"
_VALUE = r"^(.*?[=:] ?[\"']?)(.*?)([\"']?)$"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Syllables of invented names, and endings by gender.
_SYLLABLES = {
    "latin": ("ba", "ce", "di", "fo", "ga", "he", "ji", "ko", "lu", "me", "ni", "po", "ra", "se", "ti", "vu"),
    "cyrillic": ("ба", "ве", "ди", "го", "за", "ке", "ли", "мо", "ну", "пе", "ри", "со", "та", "фе", "ви", "жу"),
}
_ENDINGS = {"latin": {"m": "n", "f": "la", "n": "s"}, "cyrillic": {"m": "н", "f": "ла", "n": "с"}}
#: Rounds of the collision checks; from turn _LONGER on surrogates that a short form has too few of get longer.
_ROUNDS, _LONGER = 20, 8


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _bound(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once, however often and in whatever lambdas ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _digest(kind: Column, norm: Column, turn: Column) -> Column:
    """128 hex digits of a keyed hash."""
    seed = F.concat_ws("|", F.lit(KEY), kind, turn.cast("string"), norm)
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(F.lit("2|"), seed), 256))


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _remap(s: Column, digest: Column, letters: Column | None = None) -> Column:
    """Every digit and letter replaced by one of its class; of the first ``letters`` letters of the alphabet only."""
    n = F.lit(26) if letters is None else letters

    def one(c, i):
        b = _byte(digest, i)
        return (
            F.when(c.rlike("[0-9]"), (b % 10).cast("string"))
            .when(c.rlike("[a-z]"), F.substring(F.lit(_LOWER), b % n + 1, F.lit(1)))
            .when(c.rlike("[A-Z]"), F.substring(F.lit(_UPPER), b % n + 1, F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(_chars(s), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string."""
    def add(total, pair):
        d = pair["d"].cast("int") * F.when(pair["i"] % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    backwards = F.transform(_chars(F.reverse(digits)), lambda c, i: F.struct(c.alias("d"), i.alias("i")))
    return F.aggregate(backwards, F.lit(0), add)


def _normal(kind: Column, text: Column) -> Column:
    """What makes two mentions the same entity."""
    return (
        F.when(kind == "email", F.lower(text))
        .when(kind.isin("phone", "card", "ssn"), F.regexp_replace(text, r"[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(text, " ", ""))
        .when(kind == "secret", F.regexp_extract(text, _VALUE, 2))
        .otherwise(text)
    )


def _surrogate(kind: Column, norm: Column, turn: Column, gender: Column) -> Column:
    """The surrogate of a normal form."""
    return _bound(_digest(kind, norm, turn), lambda d: _from_digest(kind, norm, turn, gender, d))


def _from_digest(kind: Column, norm: Column, turn: Column, gender: Column, d: Column) -> Column:
    domain = F.regexp_extract(norm, "@(.*)$", 1)
    # the domain depends on the domain alone, its last label stays
    changed = _bound(_digest(F.lit("domain"), domain, F.lit(0)), lambda x: _remap(F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), x))
    mapped = F.concat(changed, F.lit("."), F.regexp_extract(domain, r"([^.]*)$", 1))
    letters = F.transform(F.sequence(F.lit(1), F.greatest(turn - _LONGER + 1, F.lit(1))), lambda i: F.substring(F.lit(_LOWER), _byte(d, i + 40) % 26 + 1, F.lit(1)))
    more = F.when(turn >= _LONGER, F.array_join(letters, "")).otherwise(F.lit(""))
    email = F.concat(_remap(F.regexp_extract(norm, "^([^@]*)@", 1), d), more, F.lit("@"), mapped)

    def octet(o, i):
        b = _byte(d, i * 2) * 256 + _byte(d, i * 2 + 1)
        return F.when((F.length(o) == 3) | (turn >= _LONGER), b % 156 + 100).when(F.length(o) == 2, b % 90 + 10).otherwise(b % 9 + 1).cast("string")

    ip = F.array_join(F.transform(F.split(norm, r"\."), octet), ".")
    body = F.concat(F.substring(norm, 1, 1), _remap(F.substring(norm, F.lit(2), F.length(norm) - 2), d))
    check = (F.lit(10) - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    last = F.when(_luhn_sum(norm) % 10 == 0, check).otherwise((check + 1 + _byte(d, F.lit(60)) % 9) % 10)
    card = F.concat(body, last.cast("string"))
    # a phone keeps what precedes its last ten digits; no part of the rest starts with 0 or 1
    head = F.substring(norm, F.lit(1), F.greatest(F.length(norm) - 10, F.lit(0)))
    tail = F.substring(norm, F.length(head) + 1, F.lit(10))
    rest = F.array_join(F.transform(_chars(tail), lambda c, i: F.when(i.isin(0, 3), _byte(d, i) % 8 + 2).otherwise(_byte(d, i) % 10).cast("string")), "")
    key = F.concat(F.substring(norm, 1, 4), _remap(F.substring(norm, F.lit(5), F.length(norm)), d))
    iban = F.concat(F.substring(norm, 1, 2), _remap(F.substring(norm, F.lit(3), F.length(norm)), d))
    secret = _remap(norm, d, F.when(norm.rlike("^[0-9a-fA-F]+$"), F.lit(6)).otherwise(F.lit(26)))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "card", card)
        .when(kind == "phone", F.concat(head, rest))
        .when(kind == "key", key)
        .when(kind == "iban", iban)
        .when(kind == "secret", F.concat(secret, more))
        .when(kind.startswith("name"), _invented_name(kind, gender, d, turn))
        .otherwise(_remap(norm, d))
    )


def _invented_name(kind: Column, gender: Column, digest: Column, turn: Column) -> Column:
    """kind: name/script; longer names with each further turn."""
    out = None
    for script, syllables in _SYLLABLES.items():
        table = F.array(*[F.lit(s) for s in syllables])
        stem = F.array_join(F.transform(F.sequence(F.lit(0), F.least(turn, F.lit(20)) + 2), lambda i: F.element_at(table, _byte(digest, i) % len(syllables) + 1)), "")
        ends = _ENDINGS[script]
        ending = F.when(gender == "m", ends["m"]).when(gender == "f", ends["f"]).otherwise(ends["n"])
        here = (kind == f"name/{script}", F.initcap(F.concat(stem, ending)))
        out = F.when(*here) if out is None else out.when(*here)
    return out


def _kind(m: Column) -> Column:
    out = None
    for k, p in PATTERNS.items():
        whole = m.rlike(rf"\A(?:{p})\z")
        out = F.when(whole, k) if out is None else out.when(whole, k)
    return out


def _gender(title: Column) -> Column:
    return F.when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f").otherwise("n")


def _name(text: Column, hint: Column) -> Column:
    """The entity of a word of a name, with the gender that its title tells (n: none)."""
    own = F.regexp_replace(text, _OWNER, "")
    script = F.when(own.rlike(r"\p{IsCyrillic}"), "name/cyrillic").otherwise("name/latin")
    return F.struct(script.alias("kind"), text.alias("text"), F.lower(own).alias("norm"), hint.alias("hint"))


def _parts(m: Column) -> Column:
    """The entities of a match as (kind, text, norm, hint): one, or for a person one for each word of the name."""
    kind = _kind(m)
    title = F.regexp_extract(m, rf"^({_TITLES})", 1)
    names = F.split(F.regexp_extract(m, rf"^(?:{_TITLES})\.? (.*)$", 1), " ")
    # given names have a gender; a family name must look the same after any title
    person = F.transform(names, lambda n, i: _name(n, F.when(i < F.size(names) - 1, _gender(title)).otherwise("n")))
    return F.when(kind == "person", person).otherwise(F.array(F.struct(kind.alias("kind"), m.alias("text"), _normal(kind, m).alias("norm"), F.lit("n").alias("hint"))))


def _bare_pattern(parts: Column) -> Column:
    """A pattern of the name words in the matches of a text, as they stand there or in capitals; null without any."""
    names = F.filter(F.flatten(parts), lambda e: e["kind"].startswith("name") & (F.length(e["norm"]) > 1))
    words = F.array_distinct(F.transform(names, lambda e: F.regexp_replace(e["text"], _OWNER, "")))
    both = F.array_distinct(F.concat(words, F.transform(words, lambda w: F.upper(w))))
    return F.when(F.size(words) > 0, F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(both, "|"), F.lit(r")(?:['’]s(?!\p{L}))?+(?!\p{L})")))


def _render(kind: Column, text: Column, s: Column) -> Column:
    """The surrogate in the format of the mention."""
    digits = F.aggregate(
        _chars(text),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda a, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(a["out"], F.substring(s, a["k"], F.lit(1))).alias("out"), (a["k"] + 1).alias("k"))).otherwise(
            F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))
        ),
    )["out"]
    own = F.regexp_replace(text, _OWNER, "")
    return (
        F.when(kind == "secret", F.concat(F.regexp_extract(text, _VALUE, 1), s, F.regexp_extract(text, _VALUE, 3)))
        .when(kind.isin("phone", "card", "ssn", "iban"), digits)
        .when((kind == "email") & (text == F.upper(text)), F.upper(s))
        .when(kind.startswith("name"), F.concat(F.when((F.length(own) > 1) & (own == F.upper(own)), F.upper(s)).otherwise(s), F.regexp_extract(text, _OWNER, 0)))
        .otherwise(s)
    )


def _matches(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))


def _found(rows: DataFrame) -> DataFrame:
    """Distinct (kind, norm, gender) of all matches; ``rows`` has ``_m``, the matches of a text."""
    e = rows.select(F.explode(F.flatten(F.transform("_m", _parts))).alias("e")).select("e.*")
    of = lambda g: F.sum((F.col("hint") == g).cast("long"))
    e = e.groupBy("kind", "norm").agg(of("m").alias("m"), of("f").alias("f"))
    return e.select("kind", "norm", F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("n").alias("gender"))


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, norm, gender) of the corpus; ``docs`` has ``text``."""
    return _found(docs.select(_matches(F.col("text")).alias("_m")))


def collisions(found: DataFrame) -> DataFrame:
    """(kind, norm, turn) of the entities whose surrogate needs a turn above 0 to differ from all others' and from every
    entity; ``found`` is a materialised table of entities."""
    group = F.split("kind", "/")[0]
    now = stored(found.withColumn("turn", F.lit(0)).withColumn("s", _surrogate(F.col("kind"), F.col("norm"), F.col("turn"), F.col("gender"))))
    known = found.select(group.alias("g"), F.col("norm").alias("real")).distinct()
    for turn in range(_ROUNDS + 1):  # more than needed: what collides in round _LONGER or later gets longer, but for numbers of fixed length
        first = now.groupBy(group.alias("g"), F.lower("s").alias("ls")).agg(F.count("*").alias("n"), F.min(F.struct("kind", "norm")).alias("one"))
        shared = first.where(F.col("n") > 1).select("g", "ls", "one")
        real = first.join(known, (first["g"] == known["g"]) & (first["ls"] == F.lower(known["real"])), "left_semi").select("g", "ls", F.lit(True).alias("taken"))
        bad = shared.join(real, ["g", "ls"], "full").select(F.col("g"), F.col("ls"), "one", F.coalesce("taken", F.lit(False)).alias("taken"))
        bad = stored(bad)
        if bad.isEmpty():
            break
        if turn == _ROUNDS:
            raise RuntimeError(f"surrogates of different entities still collide after {_ROUNDS} rounds")
        b, n = bad.alias("b"), now.alias("n")
        again = F.col("b.ls").isNotNull() & (F.col("b.taken") | (F.struct("n.kind", "n.norm") != F.col("b.one")))
        moved = n.join(b, (F.split("n.kind", "/")[0] == F.col("b.g")) & (F.lower("n.s") == F.col("b.ls")), "left").select(
            "n.kind", "n.norm", "n.gender", F.when(again, turn + 1).otherwise(F.col("n.turn")).alias("turn"), F.col("n.s").alias("old"), F.coalesce(again, F.lit(False)).alias("again")
        )
        s = F.when(F.col("again"), _surrogate(F.col("kind"), F.col("norm"), F.col("turn"), F.col("gender"))).otherwise(F.col("old"))
        now = stored(moved.select("kind", "norm", "gender", "turn", s.alias("s")))
    return now.where(F.col("turn") > 0).select("kind", "norm", "turn")


def _replaced() -> Column:
    """The text of a row of matches ``_m``, gaps around them ``_gaps`` and ``_parts``, with ``_special``: turns and genders."""

    def one(e):
        special = F.col("_special")[F.concat_ws("|", e["kind"], e["norm"])]
        turn, gender = F.coalesce(special["turn"], F.lit(0)), F.coalesce(special["gender"], F.lit("n"))
        return _bound(_surrogate(e["kind"], e["norm"], turn, gender), lambda s: _render(e["kind"], e["text"], s))

    def match(parts, m):
        names = F.concat(F.regexp_extract(m, rf"^((?:{_TITLES})\.? )", 1), F.array_join(F.transform(parts, one), " "))
        return F.when(F.element_at(parts, 1)["kind"].startswith("name"), names).otherwise(one(F.element_at(parts, 1)))

    def join(gaps, new):
        return F.array_join(F.zip_with(gaps, new, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")

    def bare(gap):
        found = F.transform(F.regexp_extract_all(gap, F.col("_bare"), F.lit(0)), lambda w: one(_name(w, F.lit("n"))))
        return F.when(gap.rlike(r"\p{Lu}"), join(F.split(gap, F.col("_bare"), -1), found)).otherwise(gap)

    gaps = F.when(F.col("_bare").isNotNull(), F.transform("_gaps", bare)).otherwise(F.col("_gaps"))
    return join(gaps, F.transform(F.arrays_zip(F.col("_parts").alias("p"), F.col("_m").alias("t")), lambda x: match(x["p"], x["t"])))


def replace_entities(docs: DataFrame) -> DataFrame:
    """``docs`` as struct ``_row`` without the text, with ``_new``, the text with surrogates, and ``_n``, how many entities
    were replaced (bare mentions of names not counted)."""
    rest = [c for c in docs.columns if c != "text"]
    row = F.struct(F.lit(True).alias("_"), *[F.col("`" + c.replace("`", "``") + "`") for c in rest])
    d = docs.select(row.alias("_row"), F.col("text").alias("_text"), _matches(F.col("text")).alias("_m"))
    some = F.size("_m") > 0
    pieces = F.when(some, F.split("_text", ANY, -1)).alias("_gaps")
    # one search of every text: what follows reads the pieces
    d = stored(d.select("_row", F.when(~some, F.col("_text")).alias("_text"), F.when(some, F.col("_m")).alias("_m"), pieces, F.monotonically_increasing_id().alias("_nr")))
    hit = d.where(F.col("_m").isNotNull())
    found = stored(_found(hit))
    moved = collisions(found)
    special = found.join(moved, ["kind", "norm"], "left").where((F.col("turn") > 0) | (F.col("gender") != "n"))
    special = special.select(F.concat_ws("|", "kind", "norm").alias("k"), F.struct(F.coalesce("turn", F.lit(0)).alias("turn"), "gender").alias("v"))
    # which texts hold entities of a later turn or with a gender
    hold = hit.select("_nr", F.explode(F.array_distinct(F.transform(F.flatten(F.transform("_m", _parts)), lambda e: F.concat_ws("|", e["kind"], e["norm"])))).alias("k"))
    hold = hold.join(special, "k").groupBy("_nr").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_special"))
    new = hit.join(stored(hold), "_nr", "left").withColumn("_parts", F.transform("_m", _parts)).withColumn("_bare", _bare_pattern(F.col("_parts")))
    new = new.select("_row", _replaced().alias("_new"), F.size("_m").alias("_n"))
    return new.union(d.where(F.col("_m").isNull()).select("_row", F.col("_text").alias("_new"), F.lit(0).alias("_n")))


def surrogates(docs: DataFrame) -> DataFrame:
    """``docs`` with the entities in ``text`` replaced; other columns as they are."""
    r = replace_entities(docs)
    return r.select(*[F.col("_new").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def surrogate_table(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, text with surrogates, n_entities."""
    return replace_entities(docs.select("doc_id", "text")).select("_row.doc_id", F.col("_new").alias("text"), F.col("_n").alias("n_entities"))
