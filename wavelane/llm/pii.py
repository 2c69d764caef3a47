"""PII: detected entities get keyed surrogates of the same type and form. DataFrame functions only.

A surrogate depends on a secret key, the kind of the entity and its canonical form, so every mention of an entity
reads alike in the whole corpus (coreference). Two different entities must not share a surrogate, and no surrogate
may be a real entity: the table of all distinct entities is checked for that, and the losers draw again until no
conflict is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized_join, written

# Forms of address by gender, given names by gender, and syllables for made-up names by script.
TITLES = {"m": "Mr Herr Monsieur Señor г-н", "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora г-жа", "n": "Dr Prof"}
GIVEN = {
    "m": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Peter Paul Hans Klaus Jürgen Wolfgang Pierre Jacques Jean Michel José Juan Carlos Luis Miguel Иван Дмитрий Сергей Алексей Пётр",
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emily Anna Emma Laura Ursula Monika Petra Sabine Marie Isabelle Sophie Claire María Carmen Ana Lucía Elena Анна Мария Ольга Елена Наталья",
}
SYLLABLES = {"L": "ba be bo da de do fa fe fi ga go ka ke ki ko la le li lo ma me mi mo na ne ni ra re ri sa so ta", "C": "ба бе бо да де до фа фе фи га го ка ке ки ко ла ле ли ло ма ме ми мо на не ни ра ре ри са со та"}
ENDINGS = {("m", "L"): "n", ("f", "L"): "lia", ("n", "L"): "s", ("m", "C"): "н", ("f", "C"): "лия", ("n", "C"): "с"}

_TITLE = "|".join(sorted(" ".join(TITLES.values()).split(), key=lambda t: (-len(t), t)))
_GIVEN = "|".join(" ".join(GIVEN.values()).split())
_CAP = r"\p{Lu}[\p{L}'’-]*+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"

#: Kind and pattern, in the order in which they are tried at each place. No capturing groups.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}",
    "secret": r"(?<![\p{L}\p{N}])(?=[TtSsPpAa])(?i:token|secret|password|passwd|api_key|apikey|access_key)\s{0,3}[=:]\s{0,3}[\"']?[\p{L}\p{N}+/_.-]{8,}+",
    "key": r"(?<![\p{L}\p{N}])(?:[0-9a-fA-F]{32,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9]{20,}+)(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "card": r"(?<![\d.+-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}(?![\d.-])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?=[\p{{Lu}}г])(?:(?:{_TITLE})\.?|(?:{_GIVEN})) {_CAP}(?: {_CAP})*+(?!\p{{L}})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Set around the matches of a text to cut it there; texts that hold it themselves are cut in another, slower way.
MARK = "\u0001\ue000\u0001"


def kind_of(m: Column) -> Column:
    """The first pattern that takes the whole match."""
    out = None
    for kind, p in PATTERNS.items():
        # Look-arounds at the ends see only the match here, so they hold.
        hit = m.rlike(rf"\A(?:{p})\z")
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return out


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tagged(found: Column) -> Column:
    """Matches as (m, kind)."""
    return F.transform(found, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))


def _alnum(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\p{L}\p{N}]", "")


def _digest(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 256)


def _number(h: Column, i: Column, below: int) -> Column:
    """A number under ``below`` from four hexadecimal digits of a digest."""
    return (F.conv(F.substring(h, F.pmod(i, F.lit(60)) + 1, F.lit(4)), 16, 10).cast("long") % below).cast("int")


def _shape(s: Column, h: Column) -> Column:
    """Digits for digits and letters for letters of the same case; hexadecimal strings stay so. Each 20 characters have
    a digest of their own, the first of them ``h``."""
    hexa = s.rlike(r"\A[0-9a-fA-F]+\z") & s.rlike("[a-fA-F]")
    more = F.transform(F.sequence(F.lit(1), F.floor(F.greatest(F.length(s), F.lit(20)) / 20).cast("int")), lambda b: F.sha2(F.concat_ws("|", h, b.cast("string")), 256))
    digests = F.when(F.length(s) > 20, F.concat(F.array(h), more)).otherwise(F.array(h))

    def one(c: Column, n: Column, is_hex: Column) -> Column:
        letter = lambda of: F.substring(F.lit(of), F.pmod(n, F.when(is_hex, F.lit(6)).otherwise(F.lit(26))) + 1, F.lit(1))
        up, low = letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), letter("abcdefghijklmnopqrstuvwxyz")
        return F.when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string")).when(c.rlike(r"\p{Lu}"), up).when(c.rlike(r"\p{L}"), low).otherwise(c)

    def every(z: Column) -> Column:
        number = lambda i: _number(F.get(z["d"], F.floor(i / 20).cast("int")), F.pmod(i, F.lit(20)) * 3, 65536)
        return F.array_join(F.transform(F.split(s, ""), lambda c, i: _let(number(i), lambda n: one(c, n, z["hexa"]))), "")

    return _let(F.struct(hexa.alias("hexa"), digests.alias("d")), every)


def _fill(raw: Column, chars: Column) -> Column:
    """``raw`` with its letters and digits, one after the other, replaced by ``chars``. Sorted by place, so that a very
    long secret costs little more than its length."""

    def use(z: Column) -> Column:
        held = F.filter(z["raw"], lambda x: x["c"].rlike(r"[\p{L}\p{N}]"))
        new = F.transform(held, lambda x, k: F.struct(x["i"].alias("i"), F.get(z["chars"], k).alias("c")))
        rest = F.filter(z["raw"], lambda x: ~x["c"].rlike(r"[\p{L}\p{N}]"))
        return F.array_join(F.transform(F.array_sort(F.concat(new, rest)), lambda x: x["c"]), "")

    each = F.transform(F.split(raw, ""), lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    return _let(F.struct(each.alias("raw"), F.split(chars, "").alias("chars")), use)


def _luhn(head: Column) -> Column:
    """``head`` and its check digit."""

    def add(total: Column, p: Column) -> Column:
        d = F.substring(head, p, F.lit(1)).cast("int")
        twice = F.pmod(F.length(head) - p, F.lit(2)) == 0
        return total + F.when(twice & (d * 2 > 9), d * 2 - 9).when(twice, d * 2).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(head)), F.lit(0), add)
    return F.concat(head, F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))


def _checked_iban(country: Column, rest: Column) -> Column:
    """An IBAN of a country and an account, with the check digits that make it 1 modulo 97."""

    def add(total: Column, c: Column) -> Column:
        digit = c.cast("int")
        return F.when(c.rlike("[0-9]"), F.pmod(total * 10 + digit, F.lit(97))).otherwise(F.pmod(total * 100 + F.ascii(c) - 55, F.lit(97)))

    total = F.aggregate(F.split(F.concat(rest, country, F.lit("00")), ""), F.lit(0), add)
    return F.concat(country, F.lpad((98 - total).cast("string"), 2, "0"), rest)


def _invented(kind: Column, h: Column) -> Column:
    """A made-up name of the script and, for given names, the gender that ``kind`` ends in."""
    words = lambda script: F.array(*map(F.lit, SYLLABLES[script].split()))
    syllables = F.when(F.endswith(kind, F.lit("C")), words("C")).otherwise(words("L"))
    ending = F.lit("")
    for (gender, script), e in ENDINGS.items():
        ending = F.when(kind == f"given_{gender}_{script}", F.lit(e)).otherwise(ending)
    return F.initcap(_let(syllables, lambda s: F.concat(*(F.get(s, _number(h, F.lit(k * 4), 32)) for k in range(5)), ending)))


def surrogate_chars(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The letters and digits that stand for an entity (for parts of names: the name).

    Kinds of name parts: ``given`` or ``surname`` with gender and script, like ``given_f_L``."""

    def use(z: Column) -> Column:
        k, h, plain, shaped, keep = (z[x] for x in ("k", "h", "plain", "shaped", "keep"))
        n = F.length(plain)
        phone = F.concat(F.substring(plain, F.lit(1), keep), (_number(h, F.lit(50), 8) + 2).cast("string"), F.substring(shaped, keep + 2, n))
        card = _let(F.concat(F.substring(plain, F.lit(1), F.lit(1)), F.substring(shaped, F.lit(2), n - 2)), _luhn)
        ip = F.concat_ws(".", *((_number(h, F.lit(12 * i), 254) + 1).cast("string") for i in range(4)))
        iban = _let(F.substring(shaped, F.lit(5), n), lambda rest: _checked_iban(F.substring(plain, F.lit(1), F.lit(2)), rest))
        fixed = F.length(F.regexp_extract(plain, r"\A(AKIA|gh[pousr]|sk)", 1))  # what tells a key's kind stays
        issued = F.concat(F.substring(plain, F.lit(1), fixed), F.substring(shaped, fixed + 1, n))
        out = F.when(k == "phone", phone).when(k == "card", card).when(k == "ip", ip).when(k == "iban", iban)
        out = out.when((k == "key") & ~plain.rlike(r"\A[0-9a-fA-F]+\z"), issued)
        # Short mailboxes and domains can have fewer forms than there are entities: late attempts grow longer.
        longer = F.concat(shaped, F.substring(h, F.lit(1), F.greatest(z["attempt"] - 7, F.lit(0))))
        out = out.when(k.isin("email", "domain"), longer)
        return out.when(F.contains(k, F.lit("_")), _invented(k, h)).otherwise(shaped)

    base = F.struct(kind.alias("k"), _digest(key, kind, canon, attempt).alias("h"), _alnum(canon).alias("plain"), attempt.alias("attempt"), F.length(F.regexp_extract(canon, r"\A\+(\d+) ", 1)).alias("keep"))  # a phone's country code stays
    full = lambda z: F.struct(z["k"].alias("k"), z["h"].alias("h"), z["plain"].alias("plain"), z["attempt"].alias("attempt"), z["keep"].alias("keep"), _shape(z["plain"], z["h"]).alias("shaped"))
    return _let(_let(base, full), use)


def _name_parts(m: Column) -> Column:
    """Title, given names, surname, gender and script of a match of kind name."""

    def more(x: Column) -> Column:
        title, words = x["title"], x["words"]
        gender = F.lit("n")
        for g in "mf":
            known = F.array(*map(F.lit, GIVEN[g].split()))
            gender = F.when((F.size(words) > 1) & F.array_contains(known, F.get(words, F.lit(0))), F.lit(g)).otherwise(gender)
        for g in "mf":
            gender = F.when(F.regexp_replace(title, "[. ]", "").isin(TITLES[g].split()), F.lit(g)).otherwise(gender)
        script = F.when(m.rlike(r"\p{IsCyrillic}\z"), F.lit("C")).otherwise(F.lit("L"))
        given = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
        ends = lambda kind, g: F.concat_ws("_", F.lit(kind), g, script)
        return F.struct(title.alias("title"), given.alias("given"), F.element_at(words, -1).alias("surname"), ends("given", gender).alias("given_kind"), ends("surname", F.lit("n")).alias("surname_kind"))

    title = F.regexp_extract(m, rf"\A((?:{_TITLE})\.? )", 1)
    return _let(_let(title, lambda t: F.struct(t.alias("title"), F.split(F.substring(m, F.length(t) + 1, F.length(m)), " ").alias("words"))), more)


def _secret_value(m: Column) -> Column:
    return F.regexp_extract(m, r"[=:]\s{0,3}[\"']?([^\s\"'=:]+)\z", 1)


def _domain(m: Column) -> Column:
    return F.lower(F.regexp_extract(m, r"@(.*)\.[^.]*\z", 1))


def _beyond(raw: Column, chars: Column) -> Column:
    """What ``chars`` holds beyond one for each letter and digit of ``raw``."""
    return F.substring(chars, F.length(_alnum(raw)) + 1, F.lit(99))


def _mailbox(canon: Column, chars: Column) -> Column:
    """The part before the @ of the surrogate of an address."""
    return F.concat(_fill(F.regexp_extract(canon, r"\A([^@]*)@", 1), chars), _beyond(canon, chars))


def canonical(kind: Column, m: Column) -> Column:
    """Canonical form of an entity other than a name: how it is written doesn't matter, only what it is."""
    digits = _alnum(m)
    code = F.when(digits.rlike("^[17]"), F.substring(digits, 1, 1)).otherwise(F.substring(digits, 1, 2))
    phone = F.when(F.startswith(m, F.lit("+")), F.concat(F.lit("+"), code, F.lit(" "), F.substring(digits, F.length(code) + 1, F.length(m)))).otherwise(_alnum(m))
    return F.when(kind == "email", F.lower(m)).when(kind == "secret", _secret_value(m)).when(kind == "ip", m).when(kind == "phone", phone).otherwise(_alnum(m))


def parts_of(found: Column) -> Column:
    """The (kind, canon) of everything in an array of (m, kind) that gets a surrogate of its own."""
    part = lambda k, c: F.struct(k.alias("kind"), c.alias("canon"))

    def one(x: Column) -> Column:
        m, kind = x["m"], x["kind"]
        names = _let(_name_parts(m), lambda n: F.concat(F.transform(n["given"], lambda g: part(n["given_kind"], F.lower(g))), F.array(part(n["surname_kind"], F.lower(n["surname"])))))
        whole = F.array(part(kind, canonical(kind, m)))
        return F.when(kind == "name", names).when(kind == "email", F.concat(whole, F.array(part(F.lit("domain"), _domain(m))))).otherwise(whole)

    return F.flatten(F.transform(found, one))


def part_surrogate(key: str, kind: Column, canon: Column, attempts: Column | None) -> Column:
    """The letters and digits that stand for an entity, at the attempt that ``attempts`` says."""
    tries = F.lit(0) if attempts is None else F.coalesce(F.try_element_at(attempts, F.concat_ws("|", kind, canon)), F.lit(0))
    return surrogate_chars(key, kind, canon, tries)


def _words_of(n: Column) -> Column:
    """The words of a name as (k, c): kind and word."""
    return F.concat(F.transform(n["given"], lambda g: F.struct(n["given_kind"].alias("k"), g.alias("c"))), F.array(F.struct(n["surname_kind"].alias("k"), n["surname"].alias("c"))))


def replace_match(key: str, x: Column, attempts: Column | None) -> Column:
    """The surrogate of one (m, kind) as it is written in the text."""
    m, kind = x["m"], x["kind"]
    chars = lambda k, canon: part_surrogate(key, k, canon, attempts)

    def name(n: Column) -> Column:
        return F.concat(n["title"], F.array_join(F.transform(_words_of(n), lambda w: chars(w["k"], F.lower(w["c"]))), " "))

    def other(c: Column) -> Column:
        domain = _domain(m)
        mail = F.concat(_mailbox(F.lower(m), c), F.lit("@"), _let(chars(F.lit("domain"), domain), lambda d: F.concat(_fill(domain, d), _beyond(domain, d))), F.regexp_extract(m, r"(\.[^.]*)\z", 1))
        value = _secret_value(m)
        secret = F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), _fill(value, c))
        return F.when(kind == "email", mail).when(kind == "secret", secret).when(kind == "ip", c).otherwise(_fill(m, c))

    return F.when(kind == "name", _let(_name_parts(m), name)).otherwise(_let(chars(kind, canonical(kind, m)), other))


def bare_names(key: str, pieces: Column, found: Column, attempts: Column | None) -> Column:
    """``pieces`` of a text with the words of the names ``found`` in it replaced where they stand alone: a given name or
    surname of three letters or more reads like in its full mention (as it does there first, if it was both)."""
    words = F.flatten(F.transform(F.filter(found, lambda x: x["kind"] == "name"), lambda x: _let(_name_parts(x["m"]), _words_of)))
    words = F.filter(words, lambda w: F.length(w["c"]) > 2)

    def use(z: Column) -> Column:
        pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.array_sort(z["c"], lambda a, b: F.length(b) - F.length(a)), "|"), F.lit(r")(?![\p{L}\p{N}])"))
        new = F.map_from_arrays(z["c"], F.transform(z["c"], lambda c: part_surrogate(key, F.get(F.filter(z["w"], lambda w: w["c"] == c), F.lit(0))["k"], F.lower(c), attempts)))

        def alone(y: Column) -> Column:
            one = lambda p: F.array_join(F.transform(F.split(F.regexp_replace(p, y["pattern"], F.lit(f"{MARK}$0{MARK}")), MARK, -1), lambda x: F.coalesce(F.try_element_at(y["new"], x), x)), "")
            return F.transform(pieces, lambda p: F.when(F.contains(p, F.lit(MARK)), p).otherwise(one(p)))

        return _let(F.struct(pattern.alias("pattern"), new.alias("new")), alone)

    named = F.exists(found, lambda x: x["kind"] == "name")
    each = _let(words, lambda w: F.when(F.size(w) > 0, _let(F.struct(w.alias("w"), F.array_distinct(F.transform(w, lambda x: x["c"])).alias("c")), use)).otherwise(pieces))
    return F.when(named, each).otherwise(pieces)


def cut_up(text: Column) -> Column:
    """A text cut at its entities: what stands before the first, the first, what stands before the next and so on."""
    marked = F.split(F.regexp_replace(text, ANY, f"{MARK}$0{MARK}"), MARK, -1)
    apart = F.array_compact(F.flatten(F.zip_with(F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda p, m: F.array(p, m))))
    return F.when(F.contains(text, F.lit(MARK)), apart).otherwise(marked)


def attempts_needed(parts: DataFrame, key: str, rounds: int = 50) -> DataFrame | None:
    """(kind, canon, attempt) of the entities that must not use attempt 0; None if there are none.

    Each round compares the surrogates of all distinct entities with each other and with the entities themselves.
    Of those that share one, the first canonical form keeps it unless it is some entity's own; the others try again.
    Addresses are compared as they are written: within their domain, for whose surrogate is its own and no real one."""
    state, settled = parts.withColumn("attempt", F.lit(0)), True
    for _ in range(rounds):
        now = state.withColumn("s", surrogate_chars(key, F.col("kind"), F.col("canon"), F.col("attempt")))
        now = now.withColumn("s", F.when(F.col("kind") == "email", F.concat(_mailbox(F.col("canon"), F.col("s")), F.regexp_extract("canon", r"(@.*)\z", 1))).otherwise(F.col("s")))
        made = now.select("kind", F.lower("s").alias("s"), "canon", F.lit(0).alias("real"))
        real = now.select("kind", F.lower(F.when(F.col("kind").isin("ip", "email"), F.col("canon")).otherwise(_alnum(F.col("canon")))).alias("s"), F.lit(None).cast("string").alias("canon"), F.lit(1).alias("real"))
        clash = made.unionByName(real).groupBy("kind", "s").agg(F.count("canon").alias("n"), F.max("real").alias("real"), F.min("canon").alias("first"))
        clash = clash.where("n > 1 OR (n = 1 AND real = 1)")
        losers = written(made.join(clash.withColumnRenamed("real", "taken"), ["kind", "s"]).where("taken = 1 OR canon <> first").select("kind", "canon"), "pii-losers")
        if losers.isEmpty():
            return None if settled else state.where("attempt > 0")
        settled = False
        state = written(state.join(losers.withColumn("lost", F.lit(1)), ["kind", "canon"], "left").select("kind", "canon", (F.col("attempt") + F.coalesce("lost", F.lit(0))).alias("attempt")), "pii-attempts")
    raise RuntimeError("surrogates still collide")


def surrogates(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``text`` rewritten, and n_entities and kinds (sorted, distinct) of what was replaced.

    Parts of a name that stand alone in the same text are replaced like in the name (not counted in n_entities). Null
    text stays null with 0 entities; empty texts stay. Null or repeated doc_ids don't matter: a row is rewritten by
    itself, only the check of collisions looks at all rows. All columns of ``docs`` are kept (a column called n_entities
    or kinds is replaced, as is one that begins with __pii_). Empty table: no rows. Frequent entities cost nothing extra:
    the distinct entities are summed up per task before they meet.

    The patterns run once over each text; what they cut it into is written with the row."""
    rows = docs.drop("n_entities", "kinds").withColumn("__pii_cut", cut_up(F.col("text")))
    hit = F.size("__pii_cut") > 1
    rows = rows.withColumn("__pii_pieces", F.when(hit, F.filter("__pii_cut", lambda x, i: i % 2 == 0))).withColumn("__pii_found", F.when(hit, tagged(F.filter("__pii_cut", lambda x, i: i % 2 == 1))))
    rows = written(rows.withColumn("text", F.when(~hit, F.col("text"))).drop("__pii_cut"), "pii-cut")  # a text in pieces isn't written twice
    some = rows.where("__pii_found IS NOT NULL")
    parts = some.select(F.explode(F.array_distinct(parts_of(F.col("__pii_found")))).alias("p")).select("p.kind", "p.canon").distinct()
    again = attempts_needed(written(parts, "pii-entities"), key)
    attempts = None
    if again is not None:
        again = written(again.select(F.concat_ws("|", "kind", "canon").alias("__pii_part"), "attempt"), "pii-again")
        rows = rows.withColumn("__pii_h", F.xxhash64("__pii_found"))
        mine = rows.where("__pii_found IS NOT NULL").select("__pii_h", F.explode(F.array_distinct(F.transform(parts_of(F.col("__pii_found")), lambda p: F.concat_ws("|", p["kind"], p["canon"])))).alias("__pii_part"))
        maps = sized_join(mine.distinct(), again, "__pii_part").groupBy("__pii_h").agg(F.map_from_entries(F.collect_list(F.struct("__pii_part", "attempt"))).alias("__pii_attempts"))
        rows = sized_join(rows, written(maps, "pii-maps"), "__pii_h", "left").drop("__pii_h")
        attempts = F.col("__pii_attempts")
    new = F.transform("__pii_found", lambda x: replace_match(key, x, attempts))
    joined = F.array_join(F.zip_with(bare_names(key, F.col("__pii_pieces"), F.col("__pii_found"), attempts), new, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    kinds = F.array_sort(F.array_distinct(F.transform("__pii_found", lambda x: x["kind"])))
    out = rows.withColumn("text", F.when(F.col("__pii_found").isNotNull(), joined).otherwise(F.col("text")))
    out = out.withColumn("n_entities", F.coalesce(F.size("__pii_found"), F.lit(0))).withColumn("kinds", F.coalesce(kinds, F.array().cast("array<string>")))
    return out.drop("__pii_found", "__pii_pieces", "__pii_attempts")
