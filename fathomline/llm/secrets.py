"""Secret scan whose false positives a random forest removes, in DataFrame operations only.

Candidates are, in this order where several begin at one place: values after a name that announces a secret and an
assignment (of six characters or more, quoted or not, with any signs), passwords in addresses (scheme://user:password@),
bodies of private key blocks, and maximal runs of 16 or more letters, digits and +/_- with a digit in them (= only at
the end). Features of a candidate: its length, how often neighbouring characters change their class (lower, upper, digit,
sign), shares of the classes, how many different characters it has, its Shannon entropy, whether it is hexadecimal, a
UUID or only digits, how much of it dictionary words cover, whether it stands for a value (a variable, a call, a
placeholder), provider prefixes, words before and after it that announce a secret or something harmless, and whether its
path is one of tests or examples. Spark's random forest is trained on labelled findings (columns candidate, before, after,
path, label); ``labelled_findings`` makes such a table by rule, of documented size.

Null text counts as empty, a null path as none; texts of any length are scanned whole. Candidates don't overlap; equal
features get equal scores. Repeated rows give repeated findings; rows with a null doc_id are scanned like any other; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, stored, whole
from .decontamination import let

#: A name that announces a secret, and the sign that assigns to it.
NAME = r"(?<![\w.\-])(?=[\w.\-]{3,}[\"'`\]]?\s{0,6}[=:])[\w.\-]*?(?i:token|secret|passw|passphrase|pwd|credential|api_?-?key|access_?-?key|auth|private_?-?key)[\w.\-]*[\"'`\]]?\s{0,6}(?:=>|:=|==?|:)\s{0,6}(?:(?i:bearer|basic)\s{1,3})?"
#: Where candidates are: for each kind what comes before and the candidate, as groups.
KINDS = [
    rf'({NAME}")([^"\n]{{6,}})"', rf"({NAME}')([^'\n]{{6,}})'", rf"({NAME}`)([^`\n]{{6,}})`", rf"({NAME})([^\s\"'`<>;,)]{{5,}}[^\s\"'`<>;,).])",
    r"(?<![A-Za-z0-9])([A-Za-z][A-Za-z0-9+.\-]{1,20}://[^\s/:@\"'<>]+:)([^\s/@\"'<>]+)@",
    r"(-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----)([^\-]{16,})",
    r"()(?<![A-Za-z0-9+/_\-])((?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}={0,2})",
]
CANDIDATE = "|".join(KINDS)
#: What every text with a candidate matches, in one quick pass.
HINT = r"(?=[tspcaTSPCA])(?i:token|secret|passw|passphrase|pwd|credential|api_?-?key|access_?-?key|auth|private)|://|[A-Za-z0-9+/_\-]{16}"
#: Characters of context on either side.
CONTEXT = 48
#: Words that cover identifiers and placeholders, words that announce secrets, and words that announce harmless strings. Fixed values.
DICTIONARY = (
    "access account action add admin all api app array auth base before body button by cache call change check class click client code color column "
    "commit config content context count create current data date db default delete demo description dev display doc document dummy edit element email end "
    "error event example export false fake field file filter first font foo footer form format from function get global group handle header height here "
    "hidden home host html http icon id image img import in index info input insert int is item job js json key label last layout left len length level "
    "line link list load local log login long main map master max menu message method min mode model module month my name nav new next node note null "
    "number object of off on open option order out page param parent password path placeholder port position post pre price print private process product "
    "profile prod public query read record ref remove replace request reset response result right root row run sample save script search secret section "
    "select server service session set show size sort source start state static status step stop store string style submit sum table tag target temp test "
    "text time title to token top total true type update upload url user utils value version view web width with word xxx year your"
).split()
ANNOUNCING = r"token|secret|passw|pwd|credential|api_?key|access_?key|auth|private_?key|bearer"
HARMLESS = r"commit|sha-?\d|md5|checksum|digest|integrity|etag|uuid|guid|hash|revision|order|phone|card|invoice|build|index|blob"
#: What stands where a secret would: variables, calls, masks and the words for nothing.
STANDS = r"(?i)^[$%{<\[(]|^(none|null|nil|true|false|undefined|string|required|optional|changeme|password|secret|token|example)\W*$|\*\*\*|\.\.\.|xxxx|\w\(|getenv|environ|process\.env|your[_\-]|change_?me|example|placeholder"
PREFIXES = r"^(AKIA|ASIA|ghp_|gho_|github_pat_|sk_live_|rk_live_|xox[abp]-|glpat-|AIza|eyJ|npm_)"
SIDE_PATH = r"(?i)(^|[/_.\-])(tests?|examples?|fixtures?|mocks?|samples?|docs?)([/_.\-]|$)"


def features() -> dict[str, Column]:
    """Columns from candidate, before, after and path."""
    text, size = F.col("candidate"), F.length("candidate")
    share = lambda pattern: 1 - F.length(F.regexp_replace(text, pattern, "")) / size
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]", "-"), "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "1")
    steps = F.length(F.regexp_replace(shape, r"(.)\1+", "$1"))

    def entropy(chars: Column) -> Column:
        each = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / size)
        return F.aggregate(each, F.lit(0.0), lambda a, p: a - p * F.log2(p))

    near, far = F.lower(F.substring_index(F.expr("right(before, 24)"), "\n", -1)), F.lower(F.concat("before", "after"))
    flag = lambda x: x.cast("double")
    return {
        "length": size.cast("double"),
        "transitions": (steps - 1) / F.greatest(size - 1, F.lit(1)),
        "digit_share": share("[0-9]"),
        "upper_share": share("[A-Z]"),
        "sign_share": share("[^A-Za-z0-9]"),
        "different": F.size(F.array_distinct(F.split(text, ""))) / F.least(size, F.lit(62)),
        "entropy": let(F.split(text, ""), entropy),
        "hexadecimal": flag(text.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "uuid": flag(text.rlike("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")),
        "only_digits": flag(text.rlike(r"^[0-9\-]+$")),
        "coverage": 1 - F.length(F.regexp_replace(F.lower(text), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")) / size,
        "in_order": share("0123456789|123456789|12345678|abcdef|ABCDEF|0000+|1111+|xxxx+|XXXX+"),
        "prefix": flag(text.rlike(PREFIXES)),
        "letters": flag(text.rlike(r"^[A-Za-z]+$")),
        "stands": flag(text.rlike(STANDS)),
        "white": share(r"\s"),
        "address": flag(F.col("before").rlike(r"://[^\s/:@]+:$")),
        "block": flag(F.col("before").rlike("PRIVATE KEY(?: BLOCK)?-----$")),
        "announced": flag(near.rlike(ANNOUNCING)),
        "assigned": flag(near.rlike(r"[=:]\s*[\"'`]?$")),
        "quoted": flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
        "harmless": flag(near.rlike(HARMLESS)),
        "announced_around": flag(far.rlike(ANNOUNCING)),
        "side_path": flag(F.coalesce(F.col("path"), F.lit("")).rlike(SIDE_PATH)),
    }


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """doc_id, path, candidate, start (characters before it), before and after."""
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), whole(text_col).alias("text"))

    def part(match: Column, of: int) -> Column:
        return F.concat(*[F.regexp_extract(match, CANDIDATE, 2 * i + of) for i in range(len(KINDS))])

    def listed(gaps: Column, found: Column) -> Column:
        starts = F.aggregate(
            F.arrays_zip(gaps.alias("gap"), found.alias("own")),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
            lambda a, x: F.struct((a["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["own"]), F.lit(0))).alias("at"), F.when(x["own"].isNull(), a["starts"]).otherwise(F.array_append(a["starts"], a["at"] + F.length(x["gap"]))).alias("starts")),
        )["starts"]

        def made(match: Column, i: Column, at: Column) -> Column:
            return let(F.struct(part(match, 1).alias("head"), part(match, 2).alias("own")), lambda x: F.struct(x["own"].alias("candidate"), (at[i] + F.length(x["head"])).alias("start"), ended(F.concat(ended(gaps[i]), x["head"])).alias("before"), F.concat(F.substring(match, F.length(x["head"]) + F.length(x["own"]) + 1, F.lit(1)), F.substring(gaps[i + 1], 1, CONTEXT)).alias("after")))

        return let(starts, lambda at: F.transform(found, lambda c, i: made(c, i, at)))

    def ended(text: Column) -> Column:
        return F.substring(text, F.greatest(F.length(text) - CONTEXT + 1, F.lit(1)), F.lit(CONTEXT))

    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
    found = let(found, lambda found: F.when(F.size(found) > 0, let(F.split("text", CANDIDATE, -1), lambda gaps: listed(gaps, found))))
    return texts.select("doc_id", "path", F.explode_outer(found).alias("x")).filter("x IS NOT NULL").select("doc_id", "path", "x.*")


def labelled_findings(spark: SparkSession, rows: int = 9000) -> DataFrame:
    """candidate, before, after, path and label, made by rule: real-looking secrets, and what scanners mistake for one."""
    seed = lambda salt: F.sha2(F.concat_ws("-", F.lit(salt), "id"), 256)
    numbers = [f"word{i}" for i in range(5)]
    base = F.regexp_replace(F.base64(F.unhex(F.concat(seed("a"), seed("b")))), "[+/=]", "")
    parts = {"hexes": seed("a"), "more": seed("b"), "base": base, "mixed": F.base64(F.unhex(seed("a"))), "all_digits": F.regexp_replace(F.concat(seed("a"), seed("b")), "[^0-9]", ""), "letters": F.regexp_replace(base, "[^A-Za-z]", "")}
    number = lambda salt, n: (F.conv(F.substring(seed(salt), 1, 8), 16, 10).cast("long") % n).cast("int")
    of = lambda salt, words: F.element_at(F.array(*map(F.lit, words)), number(salt, len(words)) + 1)
    parts |= {x: of(f"w{i}", DICTIONARY) for i, x in enumerate(numbers)}
    spread = ready(spark).range(rows).select("id", *[x.alias(k) for k, x in parts.items()])
    hexes, more, base, mixed, letters = (F.col(x) for x in ("hexes", "more", "base", "mixed", "letters"))
    word = [F.col(x) for x in numbers]
    digits = lambda n: F.substring("all_digits", 1, n)
    secret_before = of("s", ['token = "', 'TOKEN = "', "api_key: ", 'secret="', "password = '", "export AUTH_TOKEN=", "Authorization: Bearer ", '"access_key": "', "the token "])
    plain_before = of("p", ["commit ", "sha1: ", "index ", "md5 checksum ", "etag: ", "revision ", "and then the ", "see ", "in of "])
    part = lambda text, n: F.substring(text, 1, n)
    name = of("n", ["password", "DB_PASSWORD", "passwd", "pwd", "SECRET_KEY", "secret", "api_key", "apiKey", "auth_token", "client_secret", "root.password", "spring.datasource.password"])
    assigned = F.concat(name, of("g", ["=", " = ", ": ", '="', " = '", '": "', " := `", "=\n  ", " =>\n '"]))
    sign = of("y", ["&", "!", "#", "$", "@", "%", "^", "*", "?", "-", "_", ".", "+"])
    leet = F.translate(F.concat(F.initcap(word[0]), word[1]), "oaie", "04!3")
    address = F.concat(of("u", ["postgres", "mysql", "https", "redis", "amqp", "ftp"]), F.lit("://"), word[2], F.lit(":"))
    lines = lambda salt: F.base64(F.unhex(seed(salt)))
    secrets = [
        (F.concat(leet, sign, digits(2)), assigned), (F.concat(word[0], digits(1), word[1]), assigned), (F.concat(part(base, 5), sign, part(mixed, 6)), assigned), (F.concat(part(base, 8), digits(3)), assigned), (part(letters, 24), assigned),
        (F.concat(leet, digits(3)), address), (F.concat(part(base, 7), sign, part(hexes, 4)), address), (F.concat_ws("\n", F.lit(""), lines("k1"), lines("k2"), lines("k3"), F.lit("")), of("h", ["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----BEGIN OPENSSH PRIVATE KEY-----"])),
        (F.concat(part(base, 4), F.lit(" "), part(hexes, 5), F.lit(" "), word[1]), F.concat(name, F.lit(' = "'))),
        (part(hexes, 40), secret_before), (part(hexes, 40), secret_before), (F.upper(part(more, 40)), secret_before), (part(hexes, 32), secret_before), (F.concat(F.lit("AKIA"), F.upper(part(base, 16))), of("k", ["aws_access_key_id=", " ", "key "])),
        (F.concat(F.lit("ghp_"), part(base, 36)), of("k", ["export GITHUB_TOKEN=", " ", "use "])), (F.concat(F.lit("sk_live_"), part(base, 24)), of("k", ["stripe: ", " "])), (mixed, secret_before), (F.expr("substring(regexp_replace(base64(unhex(sha2(concat('c', id), 256))), '[+/=]', ''), 1, 20 + cast(id % 20 as int))"), secret_before),
    ]
    nothing = of("o", ["None", "null", "undefined", "${DB_PASSWORD}", "<password>", "changeme", "********", "required", "os.environ['KEY']", "getenv(NAME)", "%(secret)s", "string", "your_password", "example", "{{ secret }}", "xxxxxxxx", "process.env.TOKEN", "config.get(name)"])
    harmless = [
        (nothing, assigned), (nothing, assigned), (of("v", ["please", "string", "the value", "optional", "a number", "required field"]), F.concat(name, F.lit(": "))), (F.concat(word[0], F.lit("."), word[1]), assigned), (F.concat_ws("_", word[0], word[1], word[2]), assigned), (F.concat(word[0], F.initcap(word[1])), assigned),
        (of("m", ["password", "pass", "secret", "<password>", "user", "${PASSWORD}", "***"]), address), (F.concat_ws(" ", *word[:4]), assigned),
        (part(hexes, 40), plain_before), (hexes, plain_before), (part(hexes, 32), plain_before), (F.regexp_replace(part(hexes, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), of("q", ["id: ", "uuid=", " ", 'token = "'])),
        (digits(16), of("q", ["the ", "card ", "order ", ". ", "in ", "%%% "])), (digits(16), of("q", ["the ", "of ", "token ", "! ", ", "])), (F.concat_ws("_", *word[:4], F.substring(digits(1), 1, 1)), of("q", ["call ", "= ", 'key = "', "("])), (F.concat(word[0], F.initcap(word[1]), F.initcap(word[2]), F.initcap(word[3]), digits(2)), of("q", ["call ", "= ", "."])),
        (F.concat_ws("_", F.lit("your"), of("z", ["api", "secret", "access"]), F.lit("key_here"), digits(3)), secret_before), (of("z", ["0123456789abcdef0123456789abcdef01234567", "xxxxxxxxxxxxxxxxxxxxxxx1", "00000000000000000000", "EXAMPLEKEY1234567890"]), secret_before),
        (F.concat(F.lit("2024-01-"), digits(2), F.lit("T"), digits(2), F.lit("-00-00")), of("q", ["at ", "date=", " "])), (part(hexes, 40), secret_before), (F.concat(F.lit("/"), word[0], F.lit("/"), word[1], F.lit("/"), word[2], F.lit("/"), word[3], digits(2)), of("q", ["open ", "path = '"])),
    ]
    in_tests = 19  # the harmless kind that only its path tells from a secret
    kinds = [(x, before, 1) for x, before in secrets] + [(x, before, 0) for x, before in harmless]
    pick = lambda j: F.element_at(F.array(*(F.lit(k[j]) if j == 2 else k[j] for k in kinds)), (F.col("id") % len(kinds)).cast("int") + 1)
    side = F.col("id") % len(kinds) == len(secrets) + in_tests
    before = pick(1)
    quote = F.regexp_extract(before, "[\"'`]$", 0)
    made = stored(spread, "parts").select(
        pick(0).alias("candidate"),
        F.concat(F.concat_ws(" ", *word[:3]), F.lit(" "), before).alias("before"),
        F.concat(F.when(before.endswith(":") & before.contains("://"), F.lit("@")).when(before.endswith("KEY-----"), F.lit("-----END ")).otherwise(quote), of("e", [" ", "### ", "; ", ", ", "\n"]), word[4]).alias("after"),
        F.when(side, of("t", ["tests/unit/auth.py", "examples/login.md", "src/fixtures/keys.json"])).otherwise(of("t", ["src/auth.py", "src3", "config/prod.env", "main.js", "src0"])).alias("path"),
        pick(2).cast("double").alias("label"),
    )
    return made.filter(F.length("candidate") > 2)


def trained(findings: DataFrame, trees: int = 24, depth: int = 8) -> PipelineModel:
    """The forest, from labelled findings."""
    rows = stored(findings.select("label", *[x.alias(k) for k, x in features().items()]), "findings")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=11)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features()), outputCol="features"), forest]).fit(rows)


def secret_scan(docs: DataFrame, model: PipelineModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """doc_id, start, length, secret, score and is_secret of every candidate."""
    ready(docs.sparkSession)
    rows = candidates(docs, id_col, text_col, path_col)
    scored = model.transform(rows.select("doc_id", "start", "candidate", *[x.alias(k) for k, x in features().items()]))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", F.col("start").cast("long").alias("start"), F.length("candidate").cast("long").alias("length"), F.col("candidate").alias("secret"), score.alias("score"), (score >= threshold).alias("is_secret"))
