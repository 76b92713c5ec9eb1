"""Replacement of personal data by keyed surrogates, in DataFrame operations only.

Detected: e-mail addresses, payment card numbers, phone numbers, IPv4 and IPv6 addresses, IBANs, US social security
numbers, and names of persons (after a form of address, or a known given name before a surname). The words of a name that
a document has are also replaced where they stand alone in it, in the same spelling. A mention's core is what identifies
the entity: the digits of a number, an address in lower case, each word of a name. Every distinct core of the corpus
gets one surrogate, so all its mentions agree (coreference), in each mention's own format and case:

* digits stay digits and letters stay letters of their script; separators, the country code of a phone number, the first
  digit of a card, the top-level domain and private network prefixes stay; a card that passes the Luhn check still does;
* given names keep their gender (by the form of address or the name) and names keep their script.

The first 128 hex digits of SHA-512 over key, kind, core and attempt choose a surrogate. A surrogate that another core has,
or that is itself a core of the corpus, is refused and the next attempt is tried, until all are distinct; names and e-mail
addresses get longer with the attempts, so they never run out. Private IPv4 addresses and phone numbers of up to eight
digits have small spaces: a keyed permutation without fixed points serves there, and other cores are not refused.

Of two cores that want one surrogate the lesser gets it. Null text counts as empty; texts of any length are searched
whole; the replaced text depends on the text alone, so repeated rows and rows with a null doc_id are
treated alike; an empty table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW_BYTES, ready, stored, whole
from .decontamination import let

#: Forms of address by gender, and given names that are taken for one before a surname. Fixed values.
MALE_TITLES = "Mr Herr Monsieur Señor Don Mister Г-н Господин Κύριος".split()
FEMALE_TITLES = "Mrs Ms Miss Frau Madame Mme Señora Doña Г-жа Госпожа Κυρία".split()
MALE_NAMES = "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Peter Hans Klaus Jürgen Wolfgang Pierre Jean Michel Carlos José Juan Luis Иван Пётр Николай Алексей Γιώργος Νίκος".split()
FEMALE_NAMES = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Emily Anna Laura Ursula Monika Sabine Petra Marie Nathalie Isabelle Sophie María Carmen Ana Lucía Elena Анна Мария Ольга Елена Μαρία Ελένη".split()


def one_of(words: list[str]) -> str:
    """A pattern for any of the words that reads a first letter once; longer words come first, as they were meant to."""
    by_first: dict[str, list[str]] = {}
    for x in sorted(set(words), key=lambda x: (-len(x), x)):
        by_first.setdefault(x[0], []).append(x[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_first.items())


KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}",
    "iban": r"(?=[A-Z])\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?=[0-9])(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])",
    "ip6": r"(?=[0-9A-Fa-f]{1,4}:)(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}|(?:[Ff][Ee]80|[Ff][CcDd][0-9A-Fa-f]{2}|[23][0-9A-Fa-f]{3}):(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "ssn": r"(?=[0-9])(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ \-][0-9]{4}(?![0-9])|(?<![0-9][ .\-]|[0-9])(?:1[ .\-])?[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4}(?![ .\-]?[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ \-]){3}[0-9]{4}(?![0-9])|(?<![0-9])[0-9]{12,19}(?![0-9])",
}
#: A word of a name: Miller, Smith-Jones, O'Brien.
WORD = r"\p{Lu}(?:\p{L}+|['’]\p{Lu}\p{L}+)(?:[\-'’]\p{Lu}\p{L}+)*"
TITLED = rf"(?=\p{{Lu}})\b(?:{one_of(MALE_TITLES + FEMALE_TITLES)})\.? {WORD}(?: {WORD})?"
NAMED = rf"(?=\p{{Lu}})\b(?:{one_of(MALE_NAMES + FEMALE_NAMES)})(?:-\p{{Lu}}\p{{L}}+)? {WORD}"
#: \b of Java's regex takes letters of all scripts for words only with (?U).
PATTERN = "(?U)" + "|".join([*KINDS.values(), TITLED, NAMED])
PERSON = "(?U)" + "|".join([TITLED, NAMED])
#: What every text with a mention matches, in one quick pass; other texts are passed by.
HINT = rf"[0-9@]|[A-Fa-f]:[A-Fa-f:]|(?=\p{{Lu}})(?<!\p{{L}})(?:{one_of(MALE_TITLES + FEMALE_TITLES + MALE_NAMES + FEMALE_NAMES)})[. \-]"
#: Parts of surrogate names. Fixed values.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ge ka ke ko la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se sta ta te to va ve zo".split(),
    "cyrillic": "ба бе бо ва ве да де ди за ка ки ко ла ле ли ма ме ми на не но па ра ре ри ро са се та те ти то".split(),
    "greek": "βα γα δα δε ζα θα κα κι κο λα λε λι λο μα με μι να νε νι πα ρα ρε ρι σα σε τα τε τι το φα".split(),
}
ENDINGS = {
    ("latin", "given_f"): ["na", "lia", "ra", "sa"], ("latin", "given_m"): ["n", "rd", "s", "ron"], ("latin", "surname"): ["berg", "son", "ner", "tini", "dal"],
    ("cyrillic", "given_f"): ["на", "лия", "ра"], ("cyrillic", "given_m"): ["н", "р", "мир"], ("cyrillic", "surname"): ["нов", "ров", "енко"],
    ("greek", "given_f"): ["να", "λία", "ρα"], ("greek", "given_m"): ["νος", "ρης", "λος"], ("greek", "surname"): ["ίδης", "όπουλος", "άκης"],
}
LETTERS = {"[a-z]": (97, 26), "[A-Z]": (65, 26), "[0-9]": (48, 10), "[а-яё]": (1072, 32), "[А-ЯЁ]": (1040, 32), "[α-ω]": (945, 17), "[Α-Ω]": (913, 17)}
MOST_ATTEMPTS = 64
#: Attempts after which a surrogate gets longer, digits of the phone numbers that are permuted, and rounds of a permutation.
ATTEMPTS_A_LENGTH, SHORT_PHONE, ROUNDS = 4, 8, 6


def chars(text: Column) -> Column:
    return F.split(text, "")


def byte(stream: Column, i: Column) -> Column:
    """Byte i (round again after 64) of a stream of 128 hex digits."""
    return F.conv(F.substring(stream, i % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def reshaped(core: Column, stream: Column, kept: Column) -> Column:
    """core with each letter and digit after the first ``kept`` characters changed to one of its kind."""

    def changed(c: Column, i: Column) -> Column:
        out = F.when(i < kept, c)
        for pattern, (first, n) in LETTERS.items():
            out = out.when(c.rlike(pattern), F.char(F.lit(first) + byte(stream, i) % n) if first < 128 else F.element_at(F.array(*map(F.lit, map(chr, range(first, first + n)))), byte(stream, i) % n + 1))
        return out.when(c.rlike(r"\p{L}"), F.char(F.lit(97) + byte(stream, i) % 26)).otherwise(c)

    return F.array_join(F.transform(chars(core), changed), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when((F.length(digits) - i) % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(chars(digits), value), F.lit(0), lambda a, d: a + d) % 10


def card(core: Column, stream: Column) -> Column:
    head = F.expr("left(core, length(core) - 1)")
    made = reshaped(head, stream, F.lit(1))
    check = (10 - luhn(F.concat(made, F.lit("0")))) % 10
    return F.concat(made, F.when(luhn(core) == 0, check).otherwise((check + 1 + byte(stream, F.lit(63)) % 9) % 10).cast("string"))


def network(core: Column) -> Column:
    """How many parts of an IPv4 address tell its private network; 0 outside of them."""
    part = F.split(core, r"\.")
    first, second = part[0].cast("int"), part[1].cast("int")
    return F.when(first.isin(10, 127), 1).when((first == 192) & (second == 168) | (first == 172) & second.between(16, 31) | (first == 169) & (second == 254), 2).otherwise(0)


def closed(kind: Column, core: Column) -> Column:
    """Whether a core's space is so small that its surrogate comes from a permutation of it."""
    return ((kind == "ip") & (network(core) > 0)) | ((kind == "phone") & (F.length(core) <= SHORT_PHONE))


def permuted(value: Column, high: Column, low: Column, key: Column) -> Column:
    """A keyed permutation of 0 .. high * low - 1 that leaves no value in its place: permute, add an amount, permute back."""
    turn = lambda i, half: F.conv(F.substring(F.sha2(F.concat_ws("|", key, i.cast("string"), half.cast("string")), 256), 1, 8), 16, 10).cast("long")
    state = lambda h, lo: F.struct(h.cast("long").alias("h"), lo.cast("long").alias("lo"))

    def rounds(order: list[int], start: Column, sign: int) -> Column:
        def step(x: Column, i: Column) -> Column:
            even = i % 2 == 0
            moved = F.when(even, x["h"] + sign * turn(i, x["lo"])).otherwise(x["lo"] + sign * turn(i, x["h"]))
            return state(F.when(even, F.pmod(moved, high.cast("long"))).otherwise(x["h"]), F.when(even, x["lo"]).otherwise(F.pmod(moved, low.cast("long"))))

        return F.aggregate(F.array(*map(F.lit, order)), start, step)

    amount = turn(F.lit(ROUNDS), F.lit("amount")) % (high * low - 1) + 1
    halves = lambda v: state(F.floor(v / low), v % low)
    mixed = let(rounds(list(range(ROUNDS)), halves(value), 1), lambda x: (x["h"] * low + x["lo"] + amount) % (high * low))
    return let(let(mixed, lambda v: rounds(list(range(ROUNDS))[::-1], halves(v), -1)), lambda x: x["h"] * low + x["lo"])


def address(core: Column, stream: Column, key: str) -> Column:
    """An IPv4 address, of the same private network if core is in one."""
    part = F.split(core, r"\.")
    new = [(byte(stream, F.lit(i)) % 254 + 1).cast("string") for i in range(4)]
    outside = (byte(stream, F.lit(0)) % 80 + 20).cast("string")  # 20 to 99: no private network
    kept = network(core)
    value = F.when(kept == 1, part[1].cast("long") * 65536).otherwise(F.lit(0).cast("long")) + part[2].cast("long") * 256 + part[3].cast("long")
    side = F.when(kept == 1, 4096).otherwise(256).cast("long")
    secret = F.concat_ws("|", F.lit(key), F.lit("ip"), part[0], F.when(kept == 2, part[1]).otherwise(""))
    text = lambda v, unit: (F.floor(v / unit) % 256).cast("string")
    inside = let(permuted(value, side, side, secret), lambda v: F.concat_ws(".", part[0], F.when(kept == 2, part[1]).otherwise(text(v, 65536)), text(v, 256), text(v, 1)))
    return F.when(kept > 0, inside).otherwise(F.concat_ws(".", outside, *new[1:]))


def short_phone(core: Column, key: str) -> Column:
    low = F.pow(F.lit(10), F.floor(F.length(core) / 2)).cast("long")
    high = F.pow(F.lit(10), F.length(core) - F.floor(F.length(core) / 2)).cast("long")
    secret = F.concat_ws("|", F.lit(key), F.lit("phone"), F.length(core).cast("string"))
    return F.lpad(permuted(core.cast("long"), high, low, secret).cast("string"), F.length(core), F.lit("0"))


def name(core: Column, kind: Column, stream: Column, longer: Column) -> Column:
    """A name of core's script and kind, with ``longer`` more syllables."""
    script = F.when(core.rlike("[а-яё]"), "cyrillic").when(core.rlike("[α-ωά-ώ]"), "greek").otherwise("latin")
    out = F.lit(None).cast("string")
    for (letters, which), endings in ENDINGS.items():
        parts = F.array(*map(F.lit, SYLLABLES[letters]))
        body = [F.element_at(parts, byte(stream, F.lit(i)) % len(SYLLABLES[letters]) + 1) for i in range(3)]
        body[2] = F.when(byte(stream, F.lit(9)) % 2 == 0, body[2]).otherwise("")
        body += [F.when(longer > i, F.element_at(parts, byte(stream, F.lit(16 + i)) % len(SYLLABLES[letters]) + 1)).otherwise("") for i in range(MOST_ATTEMPTS // ATTEMPTS_A_LENGTH)]
        out = F.when((script == letters) & (kind == which), F.concat(*body, F.element_at(F.array(*map(F.lit, endings)), byte(stream, F.lit(5)) % len(endings) + 1))).otherwise(out)
    return out


def surrogate(key: str) -> Column:
    """The surrogate for columns kind, core and attempt."""
    kind, core = F.col("kind"), F.col("core")
    longer = F.floor(F.col("attempt") / ATTEMPTS_A_LENGTH).cast("int")
    stream = F.sha2(F.concat_ws("|", F.lit(key), kind, core, F.col("attempt").cast("string")), 512)

    def of(stream: Column) -> Column:
        domain_end = F.length(F.regexp_extract(core, r"\.[^.]*$", 0))
        more = F.substring(F.translate(F.substring(stream, 65, 64), "0123456789", "ghijklmnop"), F.lit(1), longer)
        email = F.concat(more, reshaped(F.substring(core, F.lit(1), F.length(core) - domain_end), stream, F.lit(0)), F.substring(core, F.length(core) - domain_end + 1, domain_end))
        return (
            F.when(kind == "email", email)
            .when(kind == "ip", address(core, stream, key))
            .when(kind == "ip6", F.concat_ws(":", F.substring_index(core, ":", 1), *(F.substring(stream, 4 * i + 1, 4) for i in range(7))))
            .when(kind == "card", card(core, stream))
            .when((kind == "phone") & closed(kind, core), short_phone(core, key))
            .when(kind == "phone", reshaped(core, stream, F.greatest(F.lit(0), F.length(core) - 10)))
            .when(kind == "iban", reshaped(core, stream, F.lit(2)))
            .when(kind == "ssn", reshaped(core, stream, F.lit(0)))
            .otherwise(name(core, kind, stream, longer))
        )

    return let(stream, of)


def pieces(mention: Column) -> Column:
    """The parts of a mention as structs of kind (empty: stays), piece and core."""

    def piece(kind: Column, text: Column, core: Column) -> Column:
        return F.struct(kind.alias("kind"), text.alias("piece"), core.alias("core"))

    whole_kind = reduce(lambda out, kind: out.when(mention.rlike("(?U)^(?:" + KINDS[kind] + ")$"), kind), KINDS, F.when(F.lit(False), ""))
    one = whole_kind.isNotNull()
    core = F.when(whole_kind.isin("phone", "card", "ssn"), F.regexp_replace(mention, "[^0-9]", "")).when(whole_kind == "iban", F.upper(F.regexp_replace(mention, " ", ""))).otherwise(F.lower(mention))

    def words(parts: Column) -> Column:
        title = F.regexp_replace(parts[0], r"\.$", "")
        titled = title.isin(MALE_TITLES + FEMALE_TITLES)
        gender = F.when(title.isin(FEMALE_TITLES) | F.substring_index(title, "-", 1).isin(FEMALE_NAMES), "given_f").otherwise("given_m")
        kind = lambda i: F.when((i == 0) & titled, "").when(i == F.size(parts) - 1, "surname").otherwise(gender)
        return F.transform(parts, lambda w, i: piece(kind(i), w, F.lower(w)))

    return F.when(one, F.array(piece(whole_kind, mention, core))).otherwise(let(F.split(mention, " "), words))


def rendered() -> Column:
    """The surrogate in the format of the mention: columns kind, piece, surrogate."""
    kind, piece, new = F.col("kind"), F.col("piece"), F.col("surrogate")
    fixed = r"[^0-9]"

    def numbered(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(piece, F.lit(1), i), fixed, ""))
        return F.when(c.rlike("[0-9]"), F.substring(new, before + 1, F.lit(1))).otherwise(c)

    def spaced(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(piece, F.lit(1), i), " ", ""))
        return F.when(c != " ", F.substring(new, before + 1, F.lit(1))).otherwise(c)

    cased = F.array_join(F.transform(chars(piece), lambda c, i: F.when(c == F.lower(c), F.substring(new, i + 1, F.lit(1))).otherwise(F.upper(F.substring(new, i + 1, F.lit(1))))), "")
    named = F.when((piece == F.upper(piece)) & (F.length(piece) > 1), F.upper(new)).when(F.substring(piece, 1, 1) == F.upper(F.substring(piece, 1, 1)), F.initcap(new)).otherwise(new)
    return (
        F.when(kind == "", piece)
        .when(kind.isin("phone", "card", "ssn"), F.array_join(F.transform(chars(piece), numbered), ""))
        .when(kind == "iban", F.array_join(F.transform(chars(piece), spaced), ""))
        .when((kind == "email") & (F.length(new) == F.length(piece)), cased)
        .when(kind.startswith("given") | (kind == "surname"), named)
        .otherwise(new)
    )


def space_of(kind: Column) -> Column:
    """Kinds whose cores and surrogates must not meet."""
    return F.when(kind.startswith("given"), "given").otherwise(kind)


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """kind, core and a distinct surrogate for every row of entities (distinct kind and core)."""
    entities = stored(entities.withColumn("space", space_of(F.col("kind"))), "entities")
    cores = entities.filter(~closed(F.col("kind"), F.col("core"))).select("space", F.col("core").alias("surrogate")).distinct()
    open_rows, done = entities.withColumn("attempt", F.lit(0)), None
    n = entities.count()
    for _ in range(MOST_ATTEMPTS):
        tried = open_rows.withColumn("surrogate", surrogate(key))
        fresh = tried.join(cores, ["space", "surrogate"], "left_anti")
        if done is not None:
            fresh = fresh.join(done.select("space", "surrogate"), ["space", "surrogate"], "left_anti")
        first = fresh.groupBy("space", "surrogate").agg(F.min(F.struct("kind", "core")).alias("x")).select("space", "surrogate", "x.kind", "x.core")
        first = stored(first, "assigned", n)
        done = first if done is None else done.unionByName(first)
        open_rows = stored(open_rows.join(first.select("kind", "core"), ["kind", "core"], "left_anti").withColumn("attempt", F.col("attempt") + 1), "open", n)
        if open_rows.isEmpty():
            return done.select("kind", "core", "surrogate")
    raise ValueError("a kind of entity has too few distinct surrogates")


def content(text: str) -> Column:
    """What tells texts of one doc_id apart."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def lone_names(text: Column) -> Column:
    """The words of a text's names as structs of piece and kind, longest first; null if it has none."""
    listed = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(PERSON), F.lit(0)), pieces))
    named = F.filter(listed, lambda x: (x["kind"] == "surname") | x["kind"].startswith("given"))
    words = F.array_sort(F.array_distinct(F.transform(named, lambda x: F.struct((-F.length(x["piece"])).alias("order"), x["piece"].alias("piece"), x["kind"].alias("kind")))))
    return let(words, lambda x: F.when(F.size(x) > 0, x))


def pseudonymized(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with surrogates and n_entities (mentions replaced) of every row."""
    ready(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    hinted = F.col("text").rlike(HINT)

    def listed(people: Column) -> Column:
        alone = F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}_])(?:"), F.array_join(F.transform(people, lambda x: x["piece"]), "|"), F.lit(r")(?![\p{L}\p{N}_])"))
        found = F.when(people.isNull(), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).otherwise(F.regexp_extract_all("text", alone, F.lit(0)))
        return F.struct(F.when(people.isNotNull(), alone).alias("pattern"), people.alias("people"), found.alias("found"))

    found = texts.filter(hinted).select("doc_id", content("text").alias("content"), let(lone_names(F.col("text")), listed).alias("own"))
    mentions = found.select("doc_id", "content", "own.pattern", "own.people", F.posexplode_outer("own.found").alias("pos", "mention")).filter("mention IS NOT NULL")
    known = F.filter("people", lambda x: x["piece"] == F.col("mention"))
    lone = F.transform(F.slice(known, 1, 1), lambda x: F.struct(x["kind"].alias("kind"), x["piece"].alias("piece"), F.lower(x["piece"]).alias("core")))
    own = F.when(F.coalesce(F.size(known), F.lit(0)) > 0, lone).otherwise(pieces(F.col("mention")))
    parts = mentions.select("doc_id", "content", "pattern", "pos", F.posexplode(own).alias("part", "x")).select("doc_id", "content", "pattern", "pos", "part", "x.kind", "x.piece", "x.core")
    parts = stored(parts.distinct(), "mentions")
    named = assigned(parts.filter("kind <> ''").select("kind", "core").distinct(), key)
    shown = parts.join(named, ["kind", "core"], "left").select("doc_id", "content", "pattern", "pos", "part", rendered().alias("shown"))
    by_mention = shown.groupBy("doc_id", "content", "pattern", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "shown"))), lambda x: x.shown), " ").alias("shown"))
    by_text = by_mention.groupBy("doc_id", "content", "pattern").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "shown"))), lambda x: x.shown).alias("shown"))
    by_text = stored(by_text.select(F.col("doc_id").alias("own_id"), F.col("content").alias("own_content"), "pattern", "shown"), "by_text")
    size = by_text.agg(F.sum(80 + F.coalesce(F.length("pattern"), F.lit(0)) + F.aggregate("shown", F.lit(0), lambda a, x: a + F.octet_length(x) + 16))).first()[0] or 0
    small = size <= FEW_BYTES
    own = F.broadcast(by_text) if small else by_text
    same = (F.when(hinted, content("text")) == F.col("own_content")) & F.col("doc_id").eqNullSafe(F.col("own_id"))
    joined = (texts if small else texts.filter(hinted)).join(own, same, "left")  # texts are shuffled only if the mentions are many
    gaps = F.when(F.col("pattern").isNull(), F.split("text", PATTERN, -1)).otherwise(F.split("text", F.col("pattern"), -1))
    whole_text = F.array_join(F.flatten(F.zip_with(gaps, F.concat("shown", F.array(F.lit(""))), lambda gap, new: F.array(gap, new))), "")
    changed = joined.select("doc_id", F.when(F.col("shown").isNull(), F.col("text")).otherwise(whole_text).alias("text"), F.coalesce(F.size("shown"), F.lit(0)).cast("long").alias("n_entities"))
    return changed if small else changed.unionByName(texts.filter(~hinted).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities")))
