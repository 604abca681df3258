"""URL filters by a path-template tree, in DataFrame operations only.

Explicit rules come first (host and its subdomains, path prefix, the longest
wins).  Every other url is judged by its template:

1. Urls are counted by host and path segments; purely numeric segments are
   wildcards at once.
2. Branching by branching, as deep as paths go, the children of a node become wildcards
   where there are too many for their rows (variable segments), and where their
   labelled purity does not differ significantly from their siblings' (a
   two-proportion z test); branches under one wildcard are merged.
3. A template's purity is smoothed towards the corpus's:
   (good + ALPHA * p) / (labelled + ALPHA); below ``MIN_PURITY`` it is blocked.

Segments that all paths under a node share (the common beginning of the least
and the greatest of what remains of them) are taken in one step, and so is a path
that is alone; rounds count branchings, not segments.  Counts meet in partial
sums; joins are on (host, prefix, segment) and left to adaptive execution, which
splits hot keys.

Defined results: a null url or one without ``://`` has empty host and path;
null labels are unlabelled rows; without labels every template is allowed;
repeated rows are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvigil.llm.textkit import durable

# (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MANY_BRANCHES = 8          # children of a node
MANY_SHARE = 0.3           # children per row
Z2 = 6.635                 # squared z of the 1 % level
ALPHA = 10.0
MIN_PURITY = 0.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    host = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls; of two rules of
    one length the first listed."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _segments(path: Column) -> Column:
    """The path's segments, purely numeric ones as wildcards."""
    segs = F.filter(F.split(path, "/", -1), lambda s: s != "")
    return F.transform(segs, lambda s: F.when(s.rlike(r"^[0-9]+(\.[A-Za-z]+)?$"), F.lit("*")).otherwise(s))


def _shared(a: Column, b: Column) -> Column:
    """How many leading entries two arrays share."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differ == 0, F.size(a)).otherwise(differ - 1).cast("int")


def _under(p: Column, segs: Column) -> Column:
    return F.concat(p, F.when(F.size(segs) > 0, F.concat(F.lit("/"), F.array_join(segs, "/"))).otherwise(F.lit("")))


def build_templates(urls: DataFrame) -> DataFrame:
    """(host, segs) -> template, lab, good of its template; from rows (host,
    segs, good: 1, 0 or null)."""
    sums = [F.sum(c).alias(c) for c in ("n", "lab", "good")]
    tree = urls.groupBy("host", "segs").agg(
        F.count(F.lit(1)).alias("n"), F.count("good").alias("lab"),
        F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good")) \
        .withColumns({"p": F.lit(""), "rest": F.col("segs")})
    cols = ["host", "segs", "n", "lab", "good", "p", "rest"]
    finished = []
    while True:
        # what all paths under a node share
        ends = tree.groupBy("host", "p").agg(_shared(F.min("rest"), F.max("rest")).alias("k"))
        far = tree.join(ends, ["host", "p"]).select(
            "host", "segs", "n", "lab", "good", _under(F.col("p"), F.slice("rest", F.lit(1), F.col("k"))).alias("p"),
            F.slice("rest", F.col("k") + 1, F.size("rest")).alias("rest"))
        far = durable(far.withColumn("s", F.coalesce(F.get("rest", F.lit(0)), F.lit(""))))
        node = far.groupBy("host", "p", "s").agg(*sums)
        all_ = node.groupBy("host", "p").agg(
            F.count(F.lit(1)).alias("kids"), F.sum("n").alias("all_n"),
            F.sum("lab").alias("all_lab"), F.sum("good").alias("all_good"))
        node = node.join(all_, ["host", "p"])
        rest = F.col("all_lab") - F.col("lab")
        pool = F.col("all_good") / F.col("all_lab")
        gap = F.col("good") / F.col("lab") - (F.col("all_good") - F.col("good")) / rest
        var = pool * (1 - pool) * (1 / F.col("lab") + 1 / rest)
        one_sided = (F.col("all_good") == 0) | (F.col("all_good") == F.col("all_lab"))
        alike = F.when((F.col("lab") == 0) | (rest == 0) | one_sided, F.lit(True)).otherwise(gap * gap < F.lit(Z2) * var)
        variable = (F.col("kids") >= MANY_BRANCHES) & (F.col("kids") > MANY_SHARE * F.col("all_n"))
        wild = (F.col("s") == "*") | ((F.col("kids") > 1) & (variable | alike))
        name = F.when(F.col("s") == "", F.col("p")).otherwise(
            F.concat("p", F.lit("/"), F.when(wild, F.lit("*")).otherwise(F.col("s"))))
        step = far.join(node.select("host", "p", "s", name.alias("to")), ["host", "p", "s"]).select(
            "host", "segs", "n", "lab", "good", F.col("to").alias("p"),
            F.slice("rest", F.lit(2), F.size("rest")).alias("rest"), (F.col("s") == "").alias("done"))
        step = durable(step)
        finished.append(step.where("done"))
        tree = step.where("not done").select(*cols)
        if not tree.limit(1).count():
            break
    tree = functools.reduce(DataFrame.union, [t.select("host", "segs", F.col("p").alias("template"), "lab", "good")
                                              for t in finished])
    total = tree.groupBy("host", "template").agg(F.sum("lab").alias("_lab"), F.sum("good").alias("_good"))
    return tree.select("host", "segs", "template").join(total, ["host", "template"])


def filter_urls(pages: DataFrame, url: str = "url", good: str | None = None, rules=RULES,
                min_purity: float = MIN_PURITY) -> DataFrame:
    """pages plus host, path, template, rule, verdict; ``good`` names a column
    of labels (1, 0, null), which the result leaves out."""
    names = [c for c in pages.columns if c not in ("host", "path", "template", "rule", "verdict", good)]
    host, path = url_parts(F.col(f"`{url}`"))
    label = F.col(f"`{good}`").cast("int") if good else F.lit(None).cast("int")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), host.alias("host"),
                        path.alias("path"), label.alias("good"))
    rows = rows.withColumn("segs", _segments(F.col("path")))
    sums = build_templates(rows)
    lab, ok = rows.agg(F.count("good"), F.sum("good")).first()
    prior = ok / lab if lab else 1.0
    purity = (F.col("_good") + ALPHA * prior) / (F.col("_lab") + ALPHA)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.join(sums, ["host", "segs"]).select(
        "row.*", "host", "path", "template", rule.alias("rule"),
        F.coalesce(verdict, F.when(purity < min_purity, F.lit("block")).otherwise(F.lit("allow")))
        .alias("verdict"))


def numbered_labels(pages: DataFrame, labels: DataFrame, url: str = "url", key: str = "doc_id",
                    quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """pages plus ``_good``: the label of the document whose number ends the
    url's path (good: quality and not toxic; the worst of several labels)."""
    _, path = url_parts(F.col(url))
    number = F.expr("try_cast(_digits as bigint)")
    mine = labels.where(f"{key} is not null and {quality} is not null").groupBy(
        F.col(key).cast("long").alias("_number")).agg(F.min(F.when(
            (F.col(quality) == 1) & (F.coalesce(F.col(toxic), F.lit(0)) == 0), 1).otherwise(0))
            .alias("_good"))
    rows = pages.withColumn("_digits", F.regexp_extract(path, r"/([0-9]{1,18})(?:\.[A-Za-z]+)?/?$", 1)) \
        .withColumn("_number", number).drop("_digits")
    return rows.join(mine, "_number", "left").drop("_number")


def brute_force(rows: list[tuple], rules=RULES, min_purity: float = MIN_PURITY) -> list[tuple]:
    """(host, path, template, rule, verdict) per (url, good), by walking the
    tree node by node in plain Python (for tests)."""
    import re
    from collections import defaultdict
    parts = []
    for url, good in rows:
        host = path = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        segs = [s for s in path.split("/") if s]
        short = ["*" if re.fullmatch(r"[0-9]+(\.[A-Za-z]+)?", s) else s for s in segs]
        parts.append([host, path, short, None, good, ""])
    for level in range(max((len(p[2]) for p in parts), default=0)):
        node = defaultdict(lambda: [0, 0, 0])
        for p in parts:
            seg = p[2][level] if level < len(p[2]) else ""
            c = node[p[0], p[5], seg]
            c[0] += 1
            c[1] += p[4] is not None
            c[2] += p[4] or 0
        kids = defaultdict(list)
        for (h, pre, seg), c in node.items():
            kids[h, pre].append((seg, c))
        wild = {}
        for k, own in kids.items():
            n, lab, good = (sum(c[i] for _, c in own) for i in range(3))
            for seg, c in own:
                rest = lab - c[1]
                if not c[1] or not rest or not good or good == lab:
                    alike = True
                else:
                    gap = c[2] / c[1] - (good - c[2]) / rest
                    alike = gap * gap < Z2 * (good / lab * (1 - good / lab) * (1 / c[1] + 1 / rest))
                many = len(own) >= MANY_BRANCHES and len(own) > MANY_SHARE * n
                wild[k[0], k[1], seg] = seg == "*" or (len(own) > 1 and (many or alike))
        for p in parts:
            seg = p[2][level] if level < len(p[2]) else ""
            if seg:
                p[5] += "/" + ("*" if wild[p[0], p[5], seg] else seg)
    stat = defaultdict(lambda: [0, 0])
    for p in parts:
        c = stat[p[0], p[5]]
        c[0] += p[4] is not None
        c[1] += p[4] or 0
    lab, good = (sum(c[i] for c in stat.values()) for i in range(2))
    prior = good / lab if lab else 1.0
    out = []
    for host, path, _, _, _, tpl in parts:
        fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = functools.reduce(lambda a, b: b if len(b[1] + b[2]) > len(a[1] + a[2]) else a, fit) \
            if fit else None
        c = stat[host, tpl]
        pure = (c[1] + ALPHA * prior) / (c[0] + ALPHA)
        out.append((host, path, tpl, best and best[1] + best[2],
                    best[0] if best else "block" if pure < min_purity else "allow"))
    return out
