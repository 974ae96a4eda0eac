"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

All of it is SQL functions. A pattern's matches are marked in the text with one control character and the text is
split there; the running length of the pieces gives the place of each match in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetables.functions.text import let
from pagetables.llm.common import query, table

MARK, OTHER = "\x01", "\x03"
#: Fixed values of the contract, written so that each match takes time in its own length only: runs start at their
#: first character or where the last match ended, and what cannot match differently is not tried again.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Kinds that the method adds. An account number has its country's length, whatever words follow; countries that are
#: not listed take all groups up to 34 characters. The number stands in group 1 of a look-ahead and the match is its
#: first four characters, so that no proposal hides the next one.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST",
    26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA",
    30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
HEAD = 4
_listed = "|".join(rf"(?:{names})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - HEAD}}}" for n, names in LENGTHS.items())
_other = rf"(?!{'|'.join(LENGTHS.values())})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}"
IBAN = rf"(?<![A-Za-z0-9])(?=((?:{_listed}|{_other})(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
SECRET = r"(?<![A-Za-z0-9_])[A-Za-z0-9_/+-]{12,}+"
#: What stands before a secret: a word, its sign and perhaps quotes, as in `token = "` and `"api_key": "`.
NAMED = r"(?:passw(?:or)?d|secret|token|api[_-]?key)\\?[\"'`]?\s*[=:]"

#: kind: (pattern, text that a match needs, start score, words that raise it, words that lower it)
KINDS = {
    "email": (EMAIL, "@", 0.9, "mail|contact|write|correo|courriel", "example|sample"),
    "ip": (IP, ".", 0.6, r"\bip\b|host|server|address|login", "version|release|section"),
    "card": (CARD, None, 0.8, "card|visa|credit|tarjeta|carte|karte", "isbn|order|serial"),
    "phone": (PHONE, "+", 0.6, "tel|phone|call|mobile|fax|llame|appel", "score|result"),
    "iban": (IBAN, None, 0.8, "iban|bank|account|konto|cuenta|compte", "serial|part"),
    "national_id": (NATIONAL, "-", 0.4, r"ssn|social security|tax id", "order|part|serial"),
    "secret": (SECRET, None, 0.3, NAMED + r"\s*\\?[\"'`]?$", r"(?<![a-z])(?:commits?|sha|hash(?:es)?)(?![a-z])"),
}
BASE = ("email", "ip", "card", "phone")
#: A span that the method adds needs this score; context moves a score by STEP within NEAR characters before it.
LEAST, STEP, NEAR = 0.6, 0.35, 40
#: Matches that are counted on in one array; even, as every second piece of a marked text is a match.
CHUNK = 256


def proposals(text: Column, pattern: str, head: int = 0) -> Column:
    """Leftmost matches that do not overlap, as an array of structs (s, e, v).

    With `head` a match is that many characters long and starts a value, which group 1 of `pattern` holds; values may overlap.
    """
    found = "$0$1" if head else "$0"
    marked = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(OTHER)), F.lit(pattern), F.lit(f"{MARK}{found}{MARK}"))
    empty = F.array().cast("array<struct<s:int,e:int,v:string>>")

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + (F.when(acc["odd"], head).otherwise(F.length(piece)) if head else F.length(piece))
        value = F.substring(piece, F.lit(head + 1), F.length(piece)) if head else piece
        found = F.struct(acc["at"].alias("s"), (acc["at"] + F.length(value)).alias("e"), value.alias("v"))
        return F.struct(
            end.alias("at"), (~acc["odd"]).alias("odd"),
            F.when(acc["odd"], F.array_append(acc["out"], found)).otherwise(acc["out"]).alias("out"),
        )

    def counted(chunk: Column) -> Column:
        return F.aggregate(chunk, F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), empty.alias("out")), step)

    def placed(chunks: Column) -> Column:
        starts = before(F.transform(chunks, lambda c: c["at"]), lambda a, b: a + b)
        return F.flatten(F.zip_with(chunks, starts, lambda c, start: F.transform(c["out"], lambda m: F.struct(
            (m["s"] + start).alias("s"), (m["e"] + start).alias("e"), m["v"].alias("v")
        ))))

    return let(F.split(marked, MARK, -1), lambda pieces: let(in_chunks(pieces, counted), placed))


def in_chunks(values: Column, fn) -> Column:
    """`fn` of each run of CHUNK values, as an array: what an aggregate copies at each step is bounded by CHUNK."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(CHUNK))
    return F.transform(starts, lambda i: fn(F.slice(values, i, CHUNK)))


def before(values: Column, plus) -> Column:
    """For each chunk's value what `plus` makes of 0 and the values of the chunks before it."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        values, start, lambda acc, v: F.struct(plus(acc["at"], v).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"]
    )


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def mod97(value: Column) -> Column:
    """The remainder of an account number with its first four characters moved to the end, letters as 10 to 35."""
    packed = F.replace(value, F.lit(" "))
    moved = F.concat(F.substring(packed, 5, 64), F.substring(packed, 1, 4))
    codes = F.transform(F.split(moved, ""), lambda c: F.ascii(c))

    def step(rest: Column, code: Column) -> Column:
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).when(code >= 48, (rest * 10 + code - 48) % 97).otherwise(rest)

    return F.aggregate(codes, F.lit(0), step)


def confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, "[.]"), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.length(digits(value)).between(16, 19) & F.call_function("luhn_check", digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    if kind == "iban":
        return mod97(value) == 1
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.lit(True)


def scored(kind: str, text: Column) -> Column:
    """Confirmed spans of one kind as structs (kind, s, e, score); kinds that the method adds need the least score."""
    pattern, needs, base, up, down = KINDS[kind]

    def span(m: Column, part: Column, base_at: Column) -> Column:
        at = m["s"] - base_at
        before_it = F.lower(F.substring(part, F.greatest(at - NEAR, F.lit(0)) + 1, F.least(at, F.lit(NEAR))))
        score = F.lit(base) + F.when(before_it.rlike(up), STEP).otherwise(0.0) - F.when(before_it.rlike(down), STEP).otherwise(0.0)
        return F.struct(
            F.lit(kind).alias("kind"), m["s"].alias("s"), m["e"].alias("e"),
            F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2).alias("score"),
        )

    def spans(chunk: Column) -> Column:
        """Places count from the start of a text, so each chunk of matches looks into the part of the text that it needs."""
        base_at = F.coalesce(F.greatest(F.get(chunk, F.lit(0))["s"] - NEAR, F.lit(0)), F.lit(0))
        part = F.substring(text, base_at + 1, F.coalesce(F.get(chunk, F.size(chunk) - 1)["s"], F.lit(0)) - base_at)
        return let(F.struct(base_at.alias("at"), part.alias("part")), lambda p: F.transform(chunk, lambda m: span(m, p["part"], p["at"])))

    if kind == "secret":  # its marks may stand anywhere, so look for the words first
        some = F.lower(text).rlike(NAMED)
    elif needs is None:
        some = text.rlike("[0-9]{2}|[0-9][ -][0-9]")
    else:
        some = F.contains(text, F.lit(needs))
    right = F.filter(proposals(text, pattern, HEAD if kind == "iban" else 0), lambda m: confirmed(kind, m["v"]))
    found = let(right, lambda matches: F.flatten(in_chunks(matches, spans)))
    none = F.array().cast("array<struct<kind:string,s:int,e:int,score:double>>")
    found = found if kind in BASE else F.filter(found, lambda m: m["score"] >= LEAST)
    return F.when(some, found).otherwise(none)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text and an array of (kind, s, e, score) per kind for every row of `docs` (doc_id, text).

    A null text counts as empty and has no spans; repeated rows stay; other columns are ignored.
    """
    clean = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return clean.select("doc_id", "text", *[scored(k, F.col("text")).alias(k) for k in KINDS])


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["s"], m["e"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts and span lists per row of `docs`."""
    found = find(docs)
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(F.concat(*BASE)).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat(*KINDS)).alias("spans"),
        F.concat(*KINDS).alias("scored"),
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first, then the longest, names it."""
    order = F.array_sort(F.transform(spans, lambda m: F.struct(m["s"].alias("s"), (-m["e"]).alias("e"), m["kind"].alias("kind"))))
    empty = F.array().cast("array<struct<from:int,s:int,kind:string>>")

    def step(acc: Column, m: Column) -> Column:
        found = F.struct(acc["at"].alias("from"), m["s"].alias("s"), m["kind"].alias("kind"))
        return F.struct(F.greatest(acc["at"], -m["e"]).alias("at"), F.array_append(acc["out"], found).alias("out"))

    def reached(chunk: Column) -> Column:
        return F.aggregate(chunk, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)

    def replaced(chunk: Column, start: Column) -> Column:
        """Of a chunk the gaps and tags, cut from the part of the text up to its last span."""
        last = F.get(chunk["out"], F.size(chunk["out"]) - 1)["s"]
        part = F.substring(text, start + 1, F.greatest(last - start, F.lit(0)))

        def piece(m: Column, part: Column) -> Column:
            at = F.greatest(m["from"], start)
            tag = F.concat(F.lit("<"), F.upper(m["kind"]), F.lit(">"))
            return F.when(m["s"] >= at, F.concat(F.substring(part, at - start + 1, m["s"] - at), tag)).otherwise("")

        return let(part, lambda p: F.array_join(F.transform(chunk["out"], lambda m: piece(m, p)), ""))

    def whole(chunks: Column) -> Column:
        starts = before(F.transform(chunks, lambda c: c["at"]), lambda a, b: F.greatest(a, b))
        end = F.array_max(F.transform(chunks, lambda c: c["at"]))
        return F.concat(F.array_join(F.zip_with(chunks, starts, replaced), ""), F.substring(text, end + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(order, lambda o: let(in_chunks(o, reached), whole))).otherwise(text)


def without_personal_data(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, with every span masked in text and, where there is such a column, n_chars counted anew."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    spans = F.concat(*[scored(k, F.col("text")) for k in KINDS])
    clean = rows.select("row", "text", spans.alias("spans")).select("row", masked(F.col("text"), F.col("spans")).alias("clean"))
    clean = clean.withColumn("clean", F.when(F.col("row.text").isNotNull(), F.col("clean")))
    fresh = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return clean.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents")).drop("scored")
