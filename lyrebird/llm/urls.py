"""URL filter: rules first, then the ratio of two character language models. DataFrame functions only.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to
``?``, ``#`` or the end. A rule (host, path, verdict) fits its host and all subdomains if the url's path
starts with the rule's; the longest wins, then the first given.

The models. Host and path are spelt in an alphabet of 33 symbols: a-z, 0 for a run of digits, ``.``, ``-``
(and ``_``), ``/``, ``!`` for anything else, ``^`` before the start and ``$`` at the end. What they learn from is
urls that a rule for a whole host decides (path ``/``), each spelling once, and example urls made of common host words;
rules for a path, such as a language's, say nothing about how good a host is. What the rule itself matched is cut from
a decided url's spelling, or the model would repeat the rule. The model of accepted urls mixes contexts of 3, 2, 1 and
no symbols by Witten-Bell smoothing: a context gives way to its shorter form by how many continuations it has
shown. The model of rejected urls is that one, adapted to the rejected: a context of 2 symbols, then of 3, counts
its rejected continuations and ``PRIOR`` from the model so far. So where nothing rejected has been seen the two agree,
and a url's score, the sum of the log ratios of its symbols over their number, is moved by what speaks of either.

Calibration. 3 of 16 spellings, by their MD5, are held out of the counts. Of the hundredths below which lie no more than
5 % of the held-out accepted, those of the least loss are taken (share of accepted below and of rejected not below,
together); the threshold is the middle of them, and 0 without any.

Scale. Spellings are scored once each. What is broadcast is the table of log ratios of the 4-symbol strings
that occur: 33 ** 4 rows of 16 bytes at most, whatever the corpus. Equal urls, however many, are one spelling.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule, and is blocked,
since it can't be fetched; repeated rows are judged alike; empty tables give empty results; other columns
than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

SYMBOLS = "abcdefghijklmnopqrstuvwxyz0.-/!^$"
BASE, ORDER = len(SYMBOLS), 4
#: The shortest gram, in symbols, whose rejected counts are used.
ADAPTED = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ_", "abcdefghijklmnopqrstuvwxyz-"

#: Words of hosts by what lists of unwanted sites are commonly sorted into, and words of hosts that are mostly fine.
UNWANTED = (
    "casino poker bet bets betting slots jackpot roulette bingo lottery gamble win", "pills viagra cialis pharmacy meds pharma cheap diet", "adult porn xxx sex cams escort nude erotic",
    "ads adserver track tracker click clicks popup banner affiliate promo", "spam farm seo backlinks linkfarm traffic bulk mailer", "loan loans payday cash credit money forex",
    "free download crack keygen warez torrent serial hack",
)
WANTED = (
    "university library news encyclopedia blog docs museum journal recipes forum health government school research science history travel books garden weather city council church music "
    "theatre film sports football community support developer software hardware engineering physics chemistry biology medicine law economics philosophy language dictionary culture art "
    "design photography nature environment energy transport railway airport hotel restaurant cooking family children teacher student college institute academy foundation society "
    "association project archive gallery magazine press radio television"
)
FORMS = ("www.{}.example.com/en/0.html", "{}.example.net/0/", "blog.{}.example.com/page/0", "m.{}.example.org/0")
#: What the context of a rejected url weighs before anything is seen in it.
PRIOR = 2.0


def _formed(hosts: list[str]) -> tuple[str, ...]:
    return tuple(FORMS[i % len(FORMS)].format(h) for i, h in enumerate(hosts))


def _pairs(words: str, *steps: int) -> list[str]:
    """Each word joined to those ``steps`` places on."""
    w = words.split()
    return [f"{a}-{w[(i + k) % len(w)]}" for i, a in enumerate(w) for k in steps]


ACCEPTED = _formed(WANTED.split() + _pairs(WANTED, 1))
REJECTED = _formed([h for words in UNWANTED for h in _pairs(words, 1, 3)])

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    return F.coalesce(
        F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER[:26], LOWER[:26]), F.lit(""),
    )


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict, h, p) of the longest rule that fits; nulls if none does; h and p are the lengths of its host and path. Rules are configuration: some hundreds at most."""
    found = F.struct(
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(0).alias("h"),
        F.lit(0).alias("p"),
    )
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1]), reverse=True)[::-1]:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(
            fits,
            F.struct(
                F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"),
                F.lit(len(rule_host)).alias("h"), F.lit(len(rule_path)).alias("p"),
            ),
        ).otherwise(found)
    return found


def spelling(host: Column, path: Column) -> Column:
    mapped = F.translate(F.concat(host, path), UPPER, LOWER)
    return F.regexp_replace(F.regexp_replace(mapped, "[0-9]+", "0"), r"[^a-z0./\-]", "!")


def _grams(spelt: DataFrame) -> DataFrame:
    """spelt(s, ...) -> (..., gram): one row for each symbol with the 3 before it, as a number in base 33."""
    codes = F.transform(F.split(F.concat(F.lit("^^^"), "s", F.lit("$")), ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    of = lambda k: F.col("codes")[F.col("at") + k]
    at = F.explode(F.sequence(F.lit(0), F.length("s"))).alias("at")
    placed = spelt.select("*", codes.alias("codes"), at)
    gram = ((of(0) * BASE + of(1)) * BASE + of(2)) * BASE + of(3)
    return placed.select(*spelt.columns, gram.cast("long").alias("gram"))


def _ratios(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, ratio) for the wanted grams, from counts(gram, a, r): how often the gram is in accepted and rejected urls."""
    def level(k: int) -> tuple[DataFrame, DataFrame]:
        seen = counts.groupBy((F.col("gram") % BASE**k).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        held = seen.groupBy(F.floor(F.col("g") / BASE).alias("h")).agg(
            F.sum("a").alias("na"), F.count_if(F.col("a") > 0).alias("ta"), F.sum("r").alias("nr"),
        )
        return seen, held

    shorter, adapted = None, []
    for k in range(1, ORDER + 1):
        seen, held = level(k)
        need = wanted.select(
            (F.col("gram") % BASE**k).alias("g")
        ).distinct() if k > 1 else counts.sparkSession.range(BASE).select(F.col("id").alias("g"))
        table = need.withColumn("h", F.floor(F.col("g") / BASE)).join(seen, "g", "left").join(held, "h", "left")
        if shorter is not None:
            table = table.withColumn("low", F.col("g") % BASE ** (k - 1)).join(shorter, "low")
        else:
            table = table.withColumn("p", F.lit(1.0 / BASE))
        mixed = F.when(
            F.col("na") > 0, (F.coalesce("a", F.lit(0.0)) + F.col("ta") * F.col("p")) / (F.col("na") + F.col("ta")),
        ).otherwise(F.col("p"))
        rejected = [
            F.coalesce("r", F.lit(0.0)).alias(f"r{k}"), F.coalesce("nr", F.lit(0.0)).alias(f"n{k}"),
        ] if k >= ADAPTED else []
        out = table.select("g", mixed.alias("p"), *adapted, *rejected)
        adapted += [f"r{k}", f"n{k}"] if rejected else []
        shorter = out.withColumnRenamed("g", "low")
    bad = F.col("p")
    for k in range(ADAPTED, ORDER + 1):
        bad = (F.col(f"r{k}") + PRIOR * bad) / (F.col(f"n{k}") + PRIOR)
    return out.select(F.col("g").alias("gram"), (F.log("p") - F.log(bad)).alias("ratio"))


def judge(
    pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url",
    accepted: Sequence[str] = ACCEPTED, rejected: Sequence[str] = REJECTED,
) -> DataFrame:
    """(id_col, host, path, rule, verdict, score): score is the rounded log ratio per symbol, null without a host and path."""
    spark = pages.sparkSession
    parted = pages.select(
        F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"),
    )
    found = parted.withColumn(
        "found", rule_for(F.col("host"), F.col("path"), rules),
    ).select("id", "host", "path", "found.*")
    left = F.expr("substring(host, 1, greatest(0, length(host) - h - 1))")
    right = F.concat(F.lit("/"), F.expr("substring(path, p + 1)"))
    whole = F.col("rule").isNull()
    spelt = spelling(F.when(whole, F.col("host")).otherwise(left), F.when(whole, F.col("path")).otherwise(right))
    ruled = found.select(
        "id", "host", "path", "rule", "verdict", spelt.alias("s"), (F.coalesce("p", F.lit(0)) == 1).alias("site"),
    )
    says = lambda v: F.max((F.col("site") & (F.coalesce("verdict", F.lit("")) == v)).cast("int"))
    corpus = ruled.where(F.col("s") != "").groupBy("s").agg(says("allow").alias("a"), says("block").alias("r"))
    examples = spark.createDataFrame(
        [(u, 1, 0) for u in accepted] + [(u, 0, 1) for u in rejected], "u string, a int, r int",
    ).select(spelling(F.col("u"), F.lit("")).alias("s"), "a", "r")
    every = corpus.union(examples).groupBy("s").agg(F.max("a").alias("a"), F.max("r").alias("r")).withColumn(
        "held", F.substring(F.md5("s"), 1, 1).isin("0", "1", "2"),
    )
    every = settle(every)
    grams = _grams(every)
    # 33 ** 4 rows at most, whatever the corpus, so the hint below is safe at any size.
    counts = settle(
        grams.groupBy("gram").agg(
            *[F.sum(F.when(F.col("held"), 0).otherwise(F.col(c))).cast("double").alias(c) for c in "ar"]
        )
    )
    ratios = F.broadcast(settle(_ratios(counts, counts.select("gram"))))
    scored = settle(
        grams.join(ratios, "gram").groupBy("s", "a", "r", "held").agg(
            F.round(F.sum("ratio") / F.count("*"), 6).alias("score")
        )
    )
    cut = _threshold(scored.where("held"))
    verdict = F.coalesce(
        "verdict", F.when(F.col("score") >= F.coalesce(cut.scalar(), F.lit(0.0)), "allow").otherwise("block"),
    )
    out = ruled.join(scored.select("s", "score"), "s", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")


def _threshold(held: DataFrame) -> DataFrame:
    """One row with the threshold, or null. The number of hundredths is bounded by the smoothing, not by the corpus."""
    bins = held.groupBy(F.floor(F.col("score") * 100).alias("bin")).agg(
        F.count_if(F.col("a") > 0).alias("a"), F.count_if((F.col("r") > 0) & (F.col("a") == 0)).alias("r"),
    ).where("a + r > 0")
    at = bins.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).where("lo is not null").select(
        F.explode(F.expr("sequence(lo, hi + 1)")).alias("bin")
    )
    each = at.join(bins, "bin", "left").select(
        "bin", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("r", F.lit(0)).alias("r"),
    )
    before, every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    below = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    told = each.select(
        "bin", below("a").alias("lost"), F.sum("a").over(every).alias("na"),
        (F.sum("r").over(every) - below("r")).alias("passed"), F.sum("r").over(every).alias("nr"),
    )
    # Losses as whole numbers, so that equal ones are equal: both shares times both counts.
    loss = told.where("lost * 20 <= na").withColumn(
        "loss", F.col("lost") * F.greatest("nr", F.lit(1)) + F.col("passed") * F.greatest("na", F.lit(1)),
    )
    best = loss.groupBy("loss").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    return best.agg((F.min_by(F.floor((F.col("lo") + F.col("hi")) / 2), "loss") / 100).alias("cut"))


def sql(rules: Sequence[Rule], accepted: Sequence[str] = ACCEPTED, rejected: Sequence[str] = REJECTED) -> str:
    """The same judgement of table ``pages`` in DuckDB's SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    listed = ", ".join(f"({i}, {quote(h)}, {quote(p)}, {quote(v)})" for i, (h, p, v) in enumerate(rules))
    shown = ", ".join([f"({quote(u)}, 1, 0)" for u in accepted] + [f"({quote(u)}, 0, 1)" for u in rejected])
    spelt = lambda x: f"regexp_replace(regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '[0-9]+', '0', 'g'), '[^a-z0./-]', '!', 'g')"
    cut = "CASE WHEN rule IS NULL THEN host || path ELSE substr(host, 1, greatest(0, length(host) - h - 1)) || '/' || substr(path, p + 1) END"
    number = f"list_reduce(list_transform(range(0, 4), lambda k: instr('{SYMBOLS}', substr('^^^' || s || '$', i + k, 1)) - 1), lambda x, y: x * {BASE} + y)::BIGINT"
    levels, bad, joins = "", f"p{ORDER}.p", ""
    for k in range(1, ORDER + 1):
        low, lower = (
            "l.p", f"JOIN p{k - 1} l ON l.g = n.g % {BASE ** (k - 1)}",
        ) if k > 1 else (f"(1.0::DOUBLE / {BASE})", "")
        need = f"SELECT DISTINCT gram % {BASE**k} AS g FROM counts" if k > 1 else f"SELECT range AS g FROM range({BASE})"
        levels += f""", v{k} AS (SELECT gram % {BASE**k} AS g, sum(a) AS a, sum(r) AS r FROM counts GROUP BY 1),
        h{k} AS (SELECT g // {BASE} AS h, sum(a) AS na, count(*) FILTER (a > 0) AS ta, sum(r) AS nr FROM v{k} GROUP BY 1),
        p{k} AS (SELECT n.g, CASE WHEN h.na > 0 THEN (coalesce(v.a, 0) + h.ta * {low}) / (h.na + h.ta) ELSE {low} END AS p FROM ({need}) n LEFT JOIN v{k} v ON v.g = n.g LEFT JOIN h{k} h ON h.h = n.g // {BASE} {lower})"""
        if k >= ADAPTED:
            joins += f" LEFT JOIN v{k} ON v{k}.g = p{ORDER}.g % {BASE**k} LEFT JOIN h{k} ON h{k}.h = p{ORDER}.g % {BASE**k} // {BASE}"
            bad = f"((coalesce(v{k}.r, 0) + {PRIOR}::DOUBLE * {bad}) / (coalesce(h{k}.nr, 0) + {PRIOR}::DOUBLE))"
    return f"""WITH rules(k, rh, rp, rv) AS (VALUES {listed}),
    cut AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parted AS (SELECT rid, page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER[:26]}', '{LOWER[:26]}') AS host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    hits AS (SELECT rid, rh || rp AS rule, rv, length(rh) AS h, length(rp) AS p, row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC, k) AS n FROM parted, rules
        WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
    ruled AS (SELECT rid, page_id, host, path, rule, rv AS verdict, {spelt(cut)} AS s, coalesce(p = 1, false) AS site FROM parted LEFT JOIN (SELECT * FROM hits WHERE n = 1) USING (rid)),
    shown AS (SELECT {spelt("u")} AS s, a, r FROM (VALUES {shown}) t(u, a, r)),
    spelt AS (SELECT s, max(a) AS a, max(r) AS r, substr(md5(s), 1, 1) IN ('0', '1', '2') AS held
        FROM (SELECT s, (site AND verdict = 'allow')::INT AS a, (site AND verdict = 'block')::INT AS r FROM ruled WHERE s <> '' UNION ALL SELECT * FROM shown) GROUP BY s),
    grams AS (SELECT s, a, r, held, {number} AS gram FROM (SELECT *, unnest(range(1, length(s) + 2)) AS i FROM spelt)),
    counts AS (SELECT gram, sum(CASE WHEN held THEN 0 ELSE a END)::DOUBLE AS a, sum(CASE WHEN held THEN 0 ELSE r END)::DOUBLE AS r FROM grams GROUP BY 1){levels},
    ratios AS (SELECT p{ORDER}.g, ln(p{ORDER}.p) - ln({bad}) AS ratio FROM p{ORDER}{joins}),
    scored AS (SELECT s, a, r, held, round(sum(ratio) / count(*), 6) AS score FROM grams JOIN ratios ON g = gram GROUP BY s, a, r, held),
    bins AS (SELECT floor(score * 100)::BIGINT AS bin, count(*) FILTER (a > 0) AS a, count(*) FILTER (r > 0 AND a = 0) AS r FROM scored WHERE held GROUP BY 1 HAVING count(*) FILTER (a + r > 0) > 0),
    every AS (SELECT t.bin, coalesce(a, 0) AS a, coalesce(r, 0) AS r FROM (SELECT unnest(range(min(bin), max(bin) + 2)) AS bin FROM bins) t LEFT JOIN bins USING (bin)),
    told AS (SELECT bin, coalesce(sum(a) OVER before, 0) AS lost, sum(a) OVER () AS na, sum(r) OVER () - coalesce(sum(r) OVER before, 0) AS passed, sum(r) OVER () AS nr
        FROM every WINDOW before AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    loss AS (SELECT bin, lost * greatest(nr, 1) + passed * greatest(na, 1) AS loss FROM told WHERE lost * 20 <= na),
    best AS (SELECT floor((min(bin) + max(bin)) / 2) / 100.0::DOUBLE AS cut FROM loss WHERE loss = (SELECT min(loss) FROM loss))
    SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN score >= coalesce((SELECT cut FROM best), 0) THEN 'allow' ELSE 'block' END) AS verdict, score
    FROM ruled LEFT JOIN scored USING (s)"""
