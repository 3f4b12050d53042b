"""Personal data: base patterns, and further spans by weak supervision, with DataFrame operations only.

Base spans are found by their patterns. Candidates for more are looser matches that touch no base span (telephone-like and
identity-like numbers, spelled-out addresses, titled or known names). Six labelers vote on each: + personal, - not, 0 no
opinion; two look at its form (regex), two at word lists (gazetteer), two at the words around it (context). The votes
of the whole table are counted by pattern, expectation-maximisation estimates each labeler's reliability from those
counts, and a naive Bayes span classifier is trained on the resulting posteriors, from features of form and surroundings but
not from the votes. What reaches the driver is counts by vote pattern and feature, whose number does not depend on
the table. The texts are searched once; the spans are kept in a small table, and no text moves between tasks.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.llm._common import materialize, neutral, table
from locusflow.llm._spans import digest, labelled, listing, with_matches

# The base patterns. Equal to the contract's patterns, written without backtracking.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ("email", "ip", "card", "phone")

# Looser candidates. A number that belongs to a base span or to a longer code is left out by overlap.
NUMBER = r"(?<![0-9A-Za-z.+\x2D])[(]?[0-9]{2,}+[)]?(?:[)]?[\x20./-][(]?[0-9]{2,}+[)]?)*+(?![0-9A-Za-z])"
SPELLED = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?i:at)[\])]\x20?"
    r"[A-Za-z0-9-]{1,63}+(?:\x20?[\[(](?i:dot)[\])]\x20?[A-Za-z0-9-]{1,63}+)++"
)
# Titles, frequent given names, and trigger words in the four languages of the corpus.
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Señor Señora".split()
GIVEN_NAMES = (
    "Alice Ana Anna Anne Antonio Carlos Carmen Charles Claire Daniel David Elena Elizabeth Emily Emma Francisco Franz "
    "Hans Heinrich Isabel James Jean Jennifer Johann John Jorge José Juan Julia Jürgen Karl Klaus Laura Linda Lucia Luis "
    "Manuel Maria Marie Martin Mary Michael Michel Miguel Nicolas Olivia Patricia Paul Pedro Peter Pierre Richard Robert "
    "Sarah Sophie Stefan Susan Thomas Uwe William Wolfgang"
).split()
WARM = (
    "account adresse appelez birth born call card carte cell contact correo dirección dni email fax handy iban konto "
    "licence llame mail mobile móvil name nombre nom number passport personalausweis phone reach social ssn tel telefon "
    "teléfono téléphone whatsapp"
).split()
COLD = (
    "article artikel chapter edition error figure id invoice isbn item kapitel line no order page página price ref "
    "release section seite serial step table total vers version vol volume year"
).split()
NAME = rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{'|'.join(TITLES)})\.?+\x20|(?:{'|'.join(GIVEN_NAMES)})\x20)\p{{Lu}}\p{{Ll}}++(?![\p{{L}}])"
ADDED_KINDS = ("number", "spelled", "name")
#: Cheap signs that any text with a match has.
SIGNS = {"e": "@", "i": r"[0-9]\.[0-9]", "c": r"[0-9][\x20-]?[0-9]", "p": r"\+[0-9]", "n": "[0-9]{2}", "s": r"[\[(][Aa][Tt][\])]", "g": r"\p{Lu}\p{Ll}"}

DATE = "^([0-9]{4}[./ -][0-9]{1,2}[./ -][0-9]{1,2}|[0-9]{1,2}[./ -][0-9]{1,2}[./ -][0-9]{2,4})$"

#: Hash buckets of the neighbouring word among the classifier's features.
WORD_BUCKETS = 64
LABELERS = 6


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(x: str) -> str:
    """Whether the digits in ``x`` pass Luhn's test."""
    d = f"split(reverse({_digits(x)}), '')"
    doubled = "(cast(nullif(c, '') as int) * if(i % 2 = 1, 2, 1))"
    return (
        f"aggregate(transform({d}, (c, i) -> coalesce({doubled} div 10 + {doubled} % 10, 0L)), 0L, (a, v) -> a + v) % 10 = 0"
    )


CARD_OK = f"(char_length({_digits('x.m')}) between 14 and 19 and {_luhn('x.m')})"
PHONE_OK = f"char_length({_digits('x.m')}) between 10 and 15"
IP_OK = "forall(split(x.m, '[.]'), p -> char_length(ltrim('0', p)) <= 3 and cast(concat('0', right(p, 3)) as int) <= 255)"


def _spans(docs: DataFrame, carried: list[str], text_col: str) -> DataFrame:
    """The ``carried`` columns, ``base, cand``; ``cand`` holds ``struct<start, rank, end, kind, m, before, after>``.

    ``docs`` has neutral column names.
    """
    df = docs.select(*carried, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = (("e", EMAIL), ("i", IP), ("c", CARD), ("p", PHONE), ("n", NUMBER), ("s", SPELLED), ("g", NAME))
    for name, pattern in found:
        df = with_matches(df, "t", pattern, name, SIGNS[name])
    keep = {"i": IP_OK, "c": CARD_OK, "p": PHONE_OK}
    base, cand = [], []
    for rank, (name, _) in enumerate(found):
        if rank < len(BASE_KINDS):
            base.append(labelled(name, rank, BASE_KINDS[rank], keep.get(name, "true")))
            continue
        cand.append(
            F.expr(
                f"transform(filter({name}, x -> char_length(x.m) >= 8), x -> named_struct('start', x.start, 'rank', {rank}, 'end', x.end, "
                f"'kind', '{ADDED_KINDS[rank - len(BASE_KINDS)]}', 'm', x.m, 'before', right(x.before, 40), 'after', left(x.after, 16)))"
            )
        )
    df = df.select(*carried, F.concat(*base).alias("base"), F.concat(*cand).alias("cand"))
    apart = "filter(cand, x -> not exists(base, b -> b.start < x.end and x.start < b.end))"
    return df.select(*carried, "base", F.expr(apart).alias("cand"))


def _words(names: list[str]) -> str:
    return "(?i)(?<!\\p{L})(" + "|".join(names) + ")(?!\\p{L})"


def _votes(x: str) -> str:
    """The labelers' votes on candidate ``x`` as a string of '+', '-' and '0'."""
    digits = f"char_length({_digits(x + '.m')})"
    has = lambda cond, yes, no="false": f"if({cond}, '+', if({no}, '-', '0'))"
    name = _sql(r"(?<!\p{L})(?:" + "|".join(GIVEN_NAMES) + r")(?!\p{L})")
    votes = (
        # regex: a strict form speaks for, a bare run of digits or a date against
        has(
            f"{x}.m rlike '^[(]?[0-9]{{2,5}}[)]?[ ./-][0-9]{{2,4}}[ ./-]?[0-9]{{2,5}}$' and not {x}.m rlike '{DATE}' or {x}.kind = 'spelled'",
            "",
            f"{x}.kind = 'number' and ({x}.m rlike '^[0-9]+$' or {x}.m rlike '{DATE}')",
        ),
        # regex: how many digits there are; of 14 and more, those with a right check digit are base spans already
        has(f"{digits} between 9 and 13 and not {x}.m rlike '^[0-9]+$'", "", f"{x}.kind = 'number' and {digits} not between 9 and 13"),
        # gazetteer: names, mail domains
        has(f"{x}.m rlike {name} or {x}.m rlike '(?i)(com|org|net|edu|gov|de|fr|es|eu)$' and {x}.kind = 'spelled'", ""),
        # gazetteer: titles speak for, dates and years against
        has(
            f"{x}.m rlike {_sql('^(' + '|'.join(TITLES) + ')[.]? ')}",
            "",
            f"{x}.kind = 'number' and {x}.m rlike '^(19|20)[0-9]{{2}}[./ -]|[./ -](19|20)[0-9]{{2}}$'",
        ),
        # context: words before
        has(f"{x}.before rlike {_sql(_words(WARM))}", "", f"{x}.before rlike {_sql(_words(COLD))}"),
        # context: what stands right at the candidate
        has(f"{x}.before rlike '[:=] ?$' and {x}.kind <> 'name'", "", f"{x}.before rlike '[#$€£] ?$' or {x}.after rlike '^ ?[%$€£*/=+|]'"),
    )
    return f"concat({', '.join(votes)})"


def _features(x: str) -> str:
    """The classifier's features of candidate ``x``: a fixed number of strings from bounded sets."""
    return (
        f"array(concat('kind:', {x}.kind), concat('length:', cast(least(char_length({x}.m) div 3, 10) as string)), "
        f"concat('digits:', cast(least(char_length({_digits(x + '.m')}), 20) as string)), "
        f"concat('marks:', cast(least(char_length(regexp_replace({x}.m, '[0-9A-Za-z]', '')), 6) as string)), "
        f"concat('lead:', regexp_replace(regexp_replace(left({x}.m, 3), '[0-9]', '9'), '[A-Za-z]', 'a')), "
        f"concat('word:', cast(pmod(xxhash64(lower(regexp_extract({x}.before, '([\\\\p{{L}}]+)[^\\\\p{{L}}]*$', 1))), {WORD_BUCKETS}) as string)), "
        f"concat('next:', if({x}.after rlike '^[.,;:!?]? ?\\\\p{{L}}', 'text', if({x}.after = '', 'end', 'mark'))))"
    )


def vote_counts(spans: DataFrame) -> list[tuple[str, str, int]]:
    """``(votes, feature, candidates)`` over the whole table; at most 3**6 patterns times the features' values."""
    # explode_outer: for explode Spark would first ask whether the array is empty and so find all spans twice
    one = spans.select(F.explode_outer("cand").alias("x")).filter(F.col("x").isNotNull()).select(F.expr(_votes("x")).alias("v"), F.expr(_features("x")).alias("f"))
    rows = one.select("v", F.explode("f").alias("f")).groupBy("v", "f").count().collect()
    return sorted((r["v"], r["f"], r["count"]) for r in rows)


def fit_reliabilities(patterns: dict[str, float], rounds: int = 50) -> tuple[dict[str, float], float, list[dict]]:
    """Expectation-maximisation over counted vote patterns.

    Returns each pattern's posterior, the prior, and for each labeler ``{(class, vote): probability}``. Starts at the
    majority of the votes; a labeler counts as right a few times before it has voted, so that the classes keep
    their meaning; without candidates the prior is 1/2 and nothing is known.
    """
    post = {}
    for v in patterns:
        lean = v.count("+") - v.count("-")
        post[v] = 1 / (1 + math.exp(-1.5 * lean + 0.5))
    prior, table_ = 0.5, []
    for _ in range(rounds):
        total = sum(patterns.values())
        prior = (sum(n * post[v] for v, n in patterns.items()) + 1) / (total + 2)
        table_ = []
        for i in range(LABELERS):
            p = {}
            for y in (0, 1):
                weight = {"+": 1.0 + 2.0 * y, "-": 3.0 - 2.0 * y, "0": 1.0}
                for v, n in patterns.items():
                    weight[v[i]] += n * (post[v] if y else 1 - post[v])
                for s in "+-0":
                    p[y, s] = weight[s] / sum(weight.values())
            table_.append(p)
        for v in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[1, s] / t[0, s]) for t, s in zip(table_, v, strict=True))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, prior, table_


def train_classifier(counts: list[tuple[str, str, int]]) -> tuple[float, dict[str, float]]:
    """Bias and feature weights of a naive Bayes classifier fitted to the posteriors of the votes."""
    patterns: dict[str, float] = {}
    for v, f, n in counts:
        if f.startswith("kind:"):
            patterns[v] = patterns.get(v, 0) + n
    post, prior, _ = fit_reliabilities(patterns)
    yes: dict[str, float] = {}
    no: dict[str, float] = {}
    for v, f, n in counts:
        yes[f] = yes.get(f, 0) + n * post[v]
        no[f] = no.get(f, 0) + n * (1 - post[v])
    all_yes = sum(n * post[v] for v, n in patterns.items()) + 1
    all_no = sum(n * (1 - post[v]) for v, n in patterns.items()) + 1
    weights = {f: math.log((yes[f] + 0.5) / all_yes) - math.log((no[f] + 0.5) / all_no) for f in yes}
    return math.log(prior / (1 - prior)), weights


def _train(spans: DataFrame) -> tuple[float, dict[str, float]]:
    return train_classifier(vote_counts(spans))


def _added(spans: DataFrame, model: tuple[float, dict[str, float]], threshold: float) -> DataFrame:
    """``spans`` with ``added``, the candidates that the classifier finds personal, for ``cand``."""
    bias, weights = model
    logit = math.log(threshold / (1 - threshold))
    held = F.from_json(F.lit(json.dumps({k: round(v, 6) for k, v in weights.items()})), "map<string,double>")
    scored = spans.withColumn("w", held)
    keep = f"filter(cand, x -> {bias} + aggregate({_features('x')}, 0D, (a, f) -> a + coalesce(try_element_at(w, f), 0D)) >= {logit})"
    added = F.expr(f"transform({keep}, x -> named_struct('start', x.start, 'rank', x.rank, 'end', x.end, 'kind', x.kind))")
    return scored.withColumn("added", added).drop("w", "cand")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, base, added``, arrays of ``struct<start, rank, end, kind>``.

    ``base`` holds the spans of the four patterns; ``added`` the other candidates that the classifier finds
    personal, none of which touches a base span. Null and empty texts have none; null ids and repeated rows
    are kept as they are; an empty table gives an empty result; other columns play no part.
    """
    kept = neutral(docs.select(id_col, text_col))
    id_, body = kept.columns
    spans = materialize(_spans(kept, [id_], body), "spans")
    return _added(spans, _train(spans), threshold).select(F.col(id_).alias("doc_id"), "base", "added")


def op5_weak_supervision_pii(spark, sf_dir: str) -> DataFrame:
    got = find_pii(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select(
        "doc_id",
        *[count(kind) for kind in BASE_KINDS],
        digest(listing(F.col("base"))).alias("base_sha256"),
        listing(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def mask_pii(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with every span of ``find_pii`` replaced by its kind in brackets. Columns as given, whatever their names.

    Spans are found in the row that they are masked in, so ids play no part; of spans that overlap, the first gives the kind and
    all characters go. Null texts stay null. The texts are searched twice: to learn, and to mask.
    """
    kept = neutral(docs)
    body = kept.columns[docs.columns.index(text_col)]
    model = _train(materialize(_spans(kept, [], body), "spans"))
    found = _added(_spans(kept, kept.columns, body), model, threshold).withColumn("all_spans", F.array_sort(F.concat("base", "added")))
    step = (
        f"aggregate(all_spans, struct('' as done, 0 as at), (a, x) -> if(x.start < a.at, struct(a.done as done, greatest(a.at, x.end) as at), "
        f"struct(concat(a.done, substring({body}, a.at + 1, x.start - a.at), '[', upper(x.kind), ']') as done, x.end as at)), "
        f"a -> concat(a.done, substring({body}, a.at + 1)))"
    )
    masked = found.withColumn(body, F.when(F.size("all_spans") > 0, F.expr(step)).otherwise(F.col(body)))
    return masked.select(*kept.columns).toDF(*docs.columns)
