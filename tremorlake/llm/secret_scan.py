"""Secret scans with multipart credential linking, in DataFrame functions alone.

Base spans: assignments of a secret-like name, access identifiers, long hex runs. The
linking adds weak candidates: account names (`ident`), high-variety strings (`weak`) and
service addresses (`endpoint`). On its own none is reported; an interval join of the parts
of one text (spans at most SCOPE code points apart) reports those that meet complementary
parts: a weak string meets an identifier or an address, an account name or an address
meets a secret (base or weak) and, for a weak secret, one of the other two. The join is a
sweep over the parts sorted by start: the farthest end of each kind so far and the next
start of each kind tell whether one is near. Texts are scanned in one pass, each row on
its own: nothing is shuffled. Sums and sweeps go by chunks, so the work on a text with n
parts grows as n log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns: kind -> (pattern, group that must have so many code points, that many).
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
WEAK = {
    "ident": (r"""(?i:\b(user(?:name)?|login|account|client_?id|key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", 2, 4),
    "weak": (r"[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20),
    "endpoint": (r"(?i:\b(?:https?|ftp|jdbc|postgres|mysql|redis|mongodb|amqp|s3))://[A-Za-z0-9._~:/?#@%+=&-]+|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?\b", 0, 8),
}
KINDS = [*BASE, *WEAK]
#: Cheap tests that texts pass which have a match: any of these parts, lower-cased or as they are.
GATES = {
    "assign": (True, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    "access": (False, ("AKIA",)),
    "ident": (True, ("user", "login", "account", "client", "keyid", "key_id")),
    "endpoint": (False, ("://", ".")),
}
#: Code points between two parts of one credential.
SCOPE = 200
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Elements of an array that one step of a sweep goes over; code points of a block of text.
CHUNK, BLOCK = 64, 1024
FAR = 2**30


def _none() -> Column:
    return F.array().cast("array<string>")


def _let(value: Column, use) -> Column:
    """use(value), the value being worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _last(a: Column) -> Column:
    return F.get(a, F.size(a) - 1)


def _sweep(a: Column, kind: str, zero: Column, value, combine) -> Column:
    """Running combine() of value(x) over the elements of a: within chunks, then with what the chunks before give."""
    none = F.array().cast(f"array<{kind}>")
    one = lambda chunk: F.aggregate(chunk, none, lambda done, x: F.concat(done, F.array(combine(F.coalesce(_last(done), zero), value(x)))))
    chunks = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int")), lambda c: one(F.slice(a, c * CHUNK + 1, CHUNK)))
    before = lambda cs: F.aggregate(cs, F.array(zero).cast(f"array<{kind}>"), lambda done, c: F.concat(done, F.array(combine(_last(done), _last(c)))))
    whole = lambda cs: _let(before(cs), lambda b: F.flatten(F.transform(cs, lambda c, i: F.transform(c, lambda x: combine(x, F.get(b, i))))))
    return F.when(F.size(a) > 0, _let(a, lambda a: _let(chunks(a), whole))).otherwise(none)


def _running_sum(a: Column) -> Column:
    return _sweep(a, "int", F.lit(0), lambda x: x, lambda x, y: x + y)


def _find(df: DataFrame, kinds: list[str]) -> DataFrame:
    """Adds found: spans of these kinds in column t, sorted by start, then kind."""
    gates = {k: F.lit(True) for k in kinds}
    for k in kinds:
        if k in GATES:
            low, words = GATES[k]
            t = F.col("low") if low else F.col("t")
            gate = F.lit(False)
            for w in words:
                gate = gate | t.contains(w)
            gates[k] = gate
    df = df.withColumn("low", F.lower("t"))
    df = df.withColumns({f"m_{k}": F.when(gates[k], F.regexp_extract_all("t", F.lit((BASE | WEAK)[k][0]), F.lit(0))).otherwise(_none()) for k in kinds}).drop("low")
    some = lambda k: F.size(f"m_{k}") > 0
    more = {f"p_{k}": F.when(some(k), F.split("t", (BASE | WEAK)[k][0], -1)).otherwise(_none()) for k in kinds}
    more |= {f"g_{k}": F.when(some(k), F.regexp_extract_all("t", F.lit(p), F.lit(g))).otherwise(_none()) for k, (p, g, _) in (BASE | WEAK).items() if k in kinds and g}
    df = df.withColumns(more)
    # a match starts after the pieces and matches before it
    step = lambda k: F.zip_with(F.slice(f"p_{k}", 1, F.size(f"m_{k}")), F.concat(F.array(F.lit("")), F.slice(f"m_{k}", F.lit(1), F.size(f"m_{k}") - 1)), lambda p, m: F.length(p) + F.length(m))

    def spans(k: str) -> Column:
        group, least = (BASE | WEAK)[k][1:]
        value = F.col(f"g_{k}") if group else F.col(f"m_{k}")

        def one(m, i, starts):
            start = F.get(starts, i)
            good = F.length(F.element_at(value, i + 1)) >= least
            if k == "weak":
                good = good & m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
            return F.when(good, F.struct(start.cast("int").alias("start"), F.lit(KINDS.index(k)).alias("kind"), (start + F.length(m)).cast("int").alias("end")))

        every = _let(_running_sum(step(k)), lambda starts: F.transform(f"m_{k}", lambda m, i: one(m, i, starts)))
        return F.when(some(k), F.filter(every, lambda x: x.isNotNull())).otherwise(F.array().cast(SPAN))

    found = F.concat(*[spans(k) for k in kinds])
    return df.withColumn("found", F.array_sort(found)).drop(*[f"{x}_{k}" for k in kinds for x in "mpg"])


def _by_kind(of, combine) -> tuple[str, Column, object, object]:
    """What a sweep needs to keep one number a kind."""
    names = [f"k{i}" for i in range(len(KINDS))]
    zero = F.lit(-FAR if combine is F.greatest else FAR)
    value = lambda x: F.struct(*[F.when(x["kind"] == i, of(x)).otherwise(zero).alias(n) for i, n in enumerate(names)])
    return f"struct<{','.join(f'{n}:int' for n in names)}>", F.struct(*[zero.alias(n) for n in names]), value, lambda x, y: F.struct(*[combine(x[n], y[n]).alias(n) for n in names])


def _linked(parts: Column) -> Column:
    """Base spans, and the weak ones that complementary parts bear out."""
    kind = {k: KINDS.index(k) for k in KINDS}
    ends = lambda p: _sweep(p, *_by_kind(lambda x: x["end"], F.greatest))
    starts = lambda p: F.reverse(_sweep(F.reverse(p), *_by_kind(lambda x: x["start"], F.least)))

    def keep(x, end, start):
        """end, start: by kind, the farthest end of parts up to x and the first start from x on."""

        def meets(*kinds):
            near = F.lit(False)
            for k in kinds:
                near = near | (end[f"k{kind[k]}"] >= x["start"] - SCOPE) | (start[f"k{kind[k]}"] <= x["end"] + SCOPE)
            return near

        overlaps = F.lit(False)
        for k in BASE:
            overlaps = overlaps | (end[f"k{kind[k]}"] > x["start"]) | (start[f"k{kind[k]}"] < x["end"])
        other = lambda k: meets("assign", "hex") | (meets("weak") & meets("access", k))
        borne = F.when(x["kind"] == kind["weak"], meets("access", "ident", "endpoint")).when(x["kind"] == kind["ident"], other("endpoint")).otherwise(other("ident"))
        return (x["kind"] < len(BASE)) | (~overlaps & borne)

    return _let(parts, lambda p: _let(ends(p), lambda end: _let(starts(p), lambda start: F.filter(p, lambda x, i: keep(x, F.get(end, i), F.get(start, i))))))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """docs with `secrets` added: spans (start, kind, end) in code points, kind a place in KINDS, sorted by start, then kind.

    A null or empty text has no spans; other columns stay, one named secrets is replaced.
    """
    keep = [c for c in docs.columns if c != "secrets"]
    own = docs.select(F.struct(*keep).alias("row"), F.coalesce("text", F.lit("")).alias("t"))
    parts = _find(own, KINDS).withColumn("base", F.size(F.filter("found", lambda x: x["kind"] < len(BASE))))
    several = F.size("found") > F.col("base")
    return parts.select("row.*", F.when(several, _linked(F.col("found"))).otherwise(F.col("found")).alias("secrets"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row of docs."""
    s = scan_secrets(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda x: x["kind"] < len(BASE))
    return s.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """docs with each run of overlapping secret spans in text replaced by mark; a null text stays null."""
    s = scan_secrets(docs)
    blocks = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def piece(blocks, at, to):
        first = F.floor(at / BLOCK).cast("int")
        held = F.array_join(F.slice(blocks, first + 1, F.floor((to - 1) / BLOCK).cast("int") - first + 1), "")
        return F.when(to > at, F.substr(held, at % BLOCK + 1, to - at)).otherwise(F.lit(""))

    def clean(blocks, ends, size):
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        parts = F.transform("secrets", lambda x, i: F.when(x["start"] >= before(i), F.concat(piece(blocks, before(i), x["start"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(parts, ""), piece(blocks, _last(ends), size))

    ends = _sweep(F.col("secrets"), "int", F.lit(0), lambda x: x["end"], F.greatest)
    masked = _let(blocks, lambda b: _let(ends, lambda e: clean(b, e, F.length("text"))))
    return s.withColumn("text", F.when(F.size("secrets") > 0, masked).otherwise(F.col("text"))).drop("secrets")
