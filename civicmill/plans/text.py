"""Text similarity, token trust and subject labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicmill.functions import classify as K
from civicmill.functions import text as T
from civicmill.functions.ids import spelling_key
from civicmill.operators import alignment, folds
from civicmill.operators import labels as L
from civicmill.operators import similarity as Sim
from civicmill.plans import sqltext as S
from civicmill.plans.registry import query
from civicmill.session import cut_lineage


def N():
    return F.count(F.lit(1)).alias("n")


@query("C10_companion_groups", "texts", """SELECT session, key, count(*) FILTER (WHERE bill[1]='H') AS house, count(*) FILTER (WHERE bill[1]='S') AS senate, min(bill) FILTER (WHERE bill[1]='H') AS first_house, min(bill) FILTER (WHERE bill[1]='S') AS first_senate,
 count(*) FILTER (WHERE bill[1]='H')*count(*) FILTER (WHERE bill[1]='S') AS pairs FROM (SELECT DISTINCT session, lower(trim(title)) AS key, bill FROM texts WHERE trim(title)<>'') GROUP BY 1,2 HAVING house>0 AND senate>0""")
def _(t):
    return Sim.companion_groups(t.texts)


@query("C10_tracked_pairs", "texts", "WITH b AS (SELECT DISTINCT session, lower(trim(title)) AS key, bill FROM texts WHERE trim(title)<>'') SELECT a.bill, a.key, count(*) AS counterparts, min(c.bill) AS first, max(c.bill) AS last FROM b a JOIN b c ON a.session=c.session AND a.key=c.key AND a.bill[1]<>c.bill[1] WHERE a.bill IN (SELECT 'HB'||o_orderkey FROM orders WHERE o_totalprice > 490000 UNION SELECT 'SB'||o_orderkey FROM orders WHERE o_totalprice > 490000) GROUP BY 1,2")
def _(t):
    top = t.orders.filter("o_totalprice > 490000")
    tracked = top.selectExpr("concat('HB', o_orderkey) AS bill").unionByName(top.selectExpr("concat('SB', o_orderkey) AS bill"))
    return Sim.counterparts_of(t.texts, tracked)


@query("C25_divergence", "bills", f"""WITH b AS (SELECT *, outcome IN ('signed','awaiting_governor') AS p FROM ({S.OUTCOME})), g AS (SELECT session, lower(trim(title)) AS key, count(*) FILTER (WHERE bill[1]='H' AND p) AS hp, count(*) FILTER (WHERE bill[1]='H' AND NOT p) AS hf, count(*) FILTER (WHERE bill[1]='S' AND p) AS sp, count(*) FILTER (WHERE bill[1]='S' AND NOT p) AS sf FROM b GROUP BY 1,2)
 SELECT session, CAST(sum((hp+hf)*(sp+sf)) AS BIGINT) AS pairs, CAST(sum(hp*sp) AS BIGINT) AS both, CAST(sum(hf*sf) AS BIGINT) AS neither, CAST(sum(hp*sf) AS BIGINT) AS house_only, CAST(sum(hf*sp) AS BIGINT) AS senate_only FROM g GROUP BY 1""")
def _(t):
    b = K.with_outcome(t.bills).withColumn("passed", F.when(F.col("outcome").isin("signed", "awaiting_governor"), 1).otherwise(0))
    cut = b.select("bill", "title", "session", "passed", F.col("session").alias("cut"))
    return Sim.divergence(cut, "cut").withColumnRenamed("cut", "session")


def title_bills(t):
    return t.titles.select("bill", "session", F.col("kind").alias("head"), F.concat_ws(" ", "name", F.when(F.col("size") > 25, "large goods").otherwise("goods")).alias("title"), F.col("id").alias("pos"))


_TB = "tb AS (SELECT bill, session, kind AS head, name||CASE WHEN size>25 THEN ' large goods' ELSE ' goods' END AS title, id AS pos FROM titles), tw AS (SELECT *, list_distinct(regexp_extract_all(lower(title),'[a-z]{3,}')) AS w FROM tb)"


@query("C11_companions", "titles", f"""WITH {_TB}, m AS (SELECT a.bill, b.bill AS other, b.pos FROM tw a JOIN tw b ON a.session=b.session AND a.head=b.head AND a.bill[1]<>b.bill[1] WHERE a.title=b.title OR len(list_intersect(a.w,b.w))/(len(a.w)+len(b.w)-len(list_intersect(a.w,b.w))) >= 0.6)
 SELECT bill, max_by(other, pos) AS companion FROM m GROUP BY 1""")
def _(t):
    return Sim.companions(title_bills(t))


_REC = f"""rec AS (SELECT doc_id AS key, session, {S.spelling('title')} AS nt, array_to_string(list_filter(string_split({S.spelling('title')},' '), lambda w: w<>'')[1:2],' ') AS h2, trim(regexp_replace(regexp_replace(lower(regexp_extract(trim(title),'^[^;:.]*')),'[^a-z0-9 ]',' ','g'),'\\s+',' ','g')) AS h, source AS cm, title, text FROM texts),
 lab AS (SELECT doc_id AS key, CASE quality WHEN 1 THEN 'good' ELSE 'poor' END AS label FROM labels UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic=1),
 tt AS (SELECT DISTINCT key, tok FROM (SELECT key, unnest({S.subject_tokens('title')}) AS tok FROM rec)), at0 AS (SELECT key, unnest({S.subject_tokens('text')}) AS tok FROM rec), adf AS (SELECT tok, count(*) AS df FROM at0 GROUP BY 1),
 atk AS (SELECT key, tok, df FROM (SELECT key, tok, df, row_number() OVER (PARTITION BY key ORDER BY df, tok) AS rn FROM at0 JOIN adf USING (tok)) WHERE rn<=12)"""


NEAR = 0.5  # least token similarity of a neighbour


def near_sql(name, queries, items):
    """Nearest item CTE: (key, item, sim), over all pairs that share a token."""
    return f"""{name}_q AS (SELECT key, count(*) AS n FROM {queries} GROUP BY 1), {name}_i AS (SELECT key AS item, count(*) AS m FROM {items} GROUP BY 1), {name}_sh AS (SELECT q.key, i.key AS item, count(*) AS c FROM {queries} q JOIN {items} i USING (tok) WHERE q.key<>i.key GROUP BY 1,2),
 {name} AS (SELECT key, item, sim FROM (SELECT key, item, c/(n+m-c) AS sim, row_number() OVER (PARTITION BY key ORDER BY c/(n+m-c) DESC, item) AS rn FROM {name}_sh JOIN {name}_q USING (key) JOIN {name}_i USING (item) WHERE c/(n+m-c)>={NEAR}) WHERE rn=1)"""


def _records(t):
    nt = spelling_key("title")
    return t.texts.select(F.col("doc_id").alias("key"), "session", nt.alias("nt"), F.array_join(F.slice(T.words(nt), 1, 2), " ").alias("h2"), T.title_head("title").alias("h"), F.col("source").alias("cm"), "title", "text")


def kept(t, name, make):
    """A frame several routes read, written once per run."""
    frames = t.__dict__.setdefault("_frames", {})
    if name not in frames:
        frames[name] = cut_lineage(make())
    return frames[name]


def records(t):
    return kept(t, "records", lambda: _records(t).drop("title", "text"))


def truth(t):
    def make():
        good = t.labels.select(F.col("doc_id").alias("key"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label"))
        return good.unionByName(t.labels.filter("toxic = 1").select(F.col("doc_id").alias("key"), F.lit("toxic").alias("label")))

    return kept(t, "truth", make)


def title_tokens(t):
    return kept(t, "title_tokens", lambda: _records(t).select("key", F.explode(T.subject_tokens("title")).alias("tok")))


def text_tokens(t):
    """Twelve rarest tokens per text."""
    return kept(t, "text_tokens", lambda: Sim.rarest_tokens(_records(t), "key", "text", 12).select("key", "tok"))


@query("C12_nearest", "texts", f"WITH {_REC}, q AS (SELECT key, tok FROM atk), it AS (SELECT key, tok FROM atk WHERE key IN (SELECT key FROM lab)), {near_sql('nr', 'q', 'it')} SELECT rec.key, item, round(sim,6) AS similarity FROM rec LEFT JOIN nr USING (key)")
def _(t):
    """Every text; those without a neighbour of the least similarity have a null item."""
    tok = text_tokens(t)
    items = tok.join(t.labels.select(F.col("doc_id").alias("key")), "key", "left_semi").select(F.col("key").alias("item"), "tok")
    found = Sim.nearest(tok, items, NEAR)
    return records(t).select("key").join(found, "key", "left").select("key", "item", F.round("similarity", 6).alias("similarity"))


@query("F05_rarest_tokens", "texts", f"WITH {_REC} SELECT key, tok, df FROM atk")
def _(t):
    return Sim.rarest_tokens(_records(t), "key", "text", 12)


_SHN = f"nm AS (SELECT doc_id, bill, {S.normal('text')} AS n FROM texts), sw AS (SELECT *, list_filter(string_split(n,' '), lambda w: w<>'') AS w FROM nm), sh AS (SELECT doc_id, bill, CASE WHEN len(w)=0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w)-8+1,1)+1), lambda i: array_to_string(w[i:i+7],' '))) END AS s FROM sw)"


@query("I01_shingles", "texts", f"WITH {_SHN} SELECT doc_id, CAST(len(s) AS BIGINT) AS shingles, coalesce(list_min(s),'') AS first FROM sh")
def _(t):
    d = t.texts.select("doc_id", T.shingles(T.normalize_text("text"), 8).alias("s"))
    return d.select("doc_id", F.size("s").cast("bigint").alias("shingles"), F.coalesce(F.array_min("s"), F.lit("")).alias("first"))


def text_pairs(t):
    """Each House text with the first Senate text of the same title and session, and with a text that does not exist."""
    g = Sim.companion_groups(t.texts)
    house = t.texts.filter("bill LIKE 'HB%'").select("session", Sim.title_key("title").alias("key"), F.col("bill").alias("house"))
    return house.join(g.select("session", "key", "first_senate"), ["session", "key"]).select("house", F.when(F.length("house") == 3, F.lit("SB-1")).otherwise(F.col("first_senate")).alias("senate"))


_PAIRS = f"""{_SHN}, gp AS (SELECT session, lower(trim(title)) AS key, min(bill) FILTER (WHERE bill[1]='S') AS fs FROM texts WHERE trim(title)<>'' GROUP BY 1,2 HAVING fs IS NOT NULL),
 pr AS (SELECT t.bill AS house, CASE WHEN length(t.bill)=3 THEN 'SB-1' ELSE fs END AS senate FROM texts t JOIN gp ON gp.session=t.session AND gp.key=lower(trim(t.title)) WHERE t.bill[1]='H'),
 cm AS (SELECT house, senate, CASE WHEN len(a.s)>0 AND len(b.s)>0 THEN len(list_intersect(a.s,b.s)) END AS i, len(a.s) AS na, len(b.s) AS nb FROM pr LEFT JOIN sh a ON a.bill=house LEFT JOIN sh b ON b.bill=senate),
 cp AS (SELECT house, senate, i/(na+nb-i) AS j, i/na AS ab, i/nb AS ba FROM cm), vd AS (SELECT *, (ab>=0.8 OR ba>=0.8) AND j<0.5 AS absorbed, CASE WHEN j IS NULL THEN 'unverifiable' WHEN j>=0.8 OR ((ab>=0.8 OR ba>=0.8) AND j<0.5) THEN 'confirmed' ELSE 'weak' END AS verdict FROM cp)"""


def compared(t):
    return Sim.compare_pairs(text_pairs(t), t.texts)


@query("I02_jaccard", "texts", f"WITH {_PAIRS} SELECT house, senate, round(j,4) AS jaccard FROM vd")
def _(t):
    return compared(t).select("house", "senate", "jaccard")


@query("I03_containment", "texts", f"WITH {_PAIRS} SELECT house, senate, round(ab,4) AS house_in_senate, round(ba,4) AS senate_in_house, absorbed FROM vd")
def _(t):
    return compared(t).select("house", "senate", "house_in_senate", "senate_in_house", "absorbed")


@query("I04_pair_verdict", "texts", f"WITH {_PAIRS} SELECT house, senate, verdict, CASE WHEN j>=0.8 THEN 'near-identical' WHEN j>=0.5 THEN 'substantial overlap' WHEN j>=0.15 THEN 'partial overlap' WHEN j IS NOT NULL THEN 'loose' END AS label FROM vd")
def _(t):
    return compared(t).select("house", "senate", "verdict", "label")


@query("I05_drift_summary", "texts", f"WITH {_PAIRS} SELECT count(*) FILTER (WHERE verdict='confirmed') AS confirmed, count(*) FILTER (WHERE verdict='confirmed' AND round(j,4)>=0.999) AS in_sync, count(*) FILTER (WHERE verdict='confirmed' AND round(j,4)<0.999) AS diverged, count(*) FILTER (WHERE verdict='weak') AS weak, count(*) FILTER (WHERE verdict='unverifiable') AS unverifiable FROM vd")
def _(t):
    return Sim.drift_summary(compared(t))


@query("I05_most_diverged", "texts", f"WITH {_PAIRS} SELECT house, senate, round(j,4) AS jaccard FROM vd WHERE verdict='confirmed' AND round(j,4)<0.999 ORDER BY round(j,4), house, senate LIMIT 10")
def _(t):
    return Sim.most_diverged(compared(t)).select("house", "senate", "jaccard")


@query("I03_benchmark_passages", "texts", f"""WITH {_SHN}, bq AS (SELECT item_id, list_filter(string_split({S.normal('text')},' '), lambda w: w<>'') AS w FROM benchmark), bs AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, greatest(len(w)-8+1,1)+1), lambda i: array_to_string(w[i:i+7],' ')))) AS g FROM bq WHERE len(w)>0),
 bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1), dg AS (SELECT doc_id, unnest(s) AS g FROM sh) SELECT doc_id, item_id, round(count(*)/any_value(n),4) AS contained FROM bs JOIN dg USING (g) JOIN bn USING (item_id) GROUP BY 1,2""")
def _(t):
    """Share of each known passage found inside each text; joined on shingles, counted after map-side combine."""
    shing = lambda df, k: df.select(k, F.explode(T.shingle_hashes(T.normalize_text("text"), 8)).alias("g"))
    passages = shing(t.benchmark, "item_id")
    size = passages.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    hits = shing(t.texts, "doc_id").join(passages, "g").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("h"))
    return hits.join(size, "item_id").select("doc_id", "item_id", F.round(F.col("h") / F.col("n"), 4).alias("contained"))


@query("E16_version_pairs", "versions", """SELECT bill, 'step' AS kind, p AS from_label, label AS to_label, CAST(length(pt) AS BIGINT) AS chars_a, CAST(length(text) AS BIGINT) AS chars_b FROM (SELECT *, lag(label) OVER w AS p, lag(text) OVER w AS pt FROM versions WINDOW w AS (PARTITION BY bill ORDER BY version)) WHERE p IS NOT NULL
 UNION ALL SELECT bill, 'total', min_by(label, version), max_by(label, version), length(min_by(text, version)), length(max_by(text, version)) FROM versions GROUP BY 1 HAVING count(*)>=2""")
def _(t):
    p = Sim.version_pairs(t.versions)
    return p.select("bill", "kind", "from_label", "to_label", F.length("text_a").cast("bigint").alias("chars_a"), F.length("text_b").cast("bigint").alias("chars_b"))


@query("I06_version_difference", "versions", f"""WITH w AS (SELECT bill, version, label, list_filter(string_split({S.normal('text')},' '), lambda x: x<>'') AS w FROM versions), s AS (SELECT *, CASE WHEN len(w)=0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w)-2,1)+1), lambda i: array_to_string(w[i:i+2],' '))) END AS s FROM w),
 p AS (SELECT bill, 'step' AS kind, lag(label) OVER v AS from_label, label AS to_label, lag(s) OVER v AS a, s AS b FROM s WINDOW v AS (PARTITION BY bill ORDER BY version) UNION ALL SELECT bill, 'total', min_by(label, version), max_by(label, version), min_by(s, version), max_by(s, version) FROM s GROUP BY 1 HAVING count(*)>=2)
 SELECT bill, kind, from_label, to_label, CASE WHEN len(a)>0 AND len(b)>0 THEN round((1-len(list_intersect(a,b))/(len(a)+len(b)-len(list_intersect(a,b))))*100,1) END AS pct FROM p WHERE from_label IS NOT NULL""")
def _(t):
    """Share of three-word runs that only one of two versions has, in percent."""
    p = Sim.version_pairs(t.versions)
    cut = lambda c: T.shingle_hashes(T.normalize_text(c), 3)
    p = p.select("bill", "kind", "from_label", "to_label", cut("text_a").alias("a"), cut("text_b").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    changed = F.round((1 - both / (F.size("a") + F.size("b") - both)) * 100, 1)
    return p.select("bill", "kind", "from_label", "to_label", F.when((F.size("a") > 0) & (F.size("b") > 0), changed).alias("pct"))


@query("I06_version_alignment", "versions")
def _(t):
    """Percentage of words that an order-keeping alignment of two versions leaves out; SQL has no longest rising run."""
    # a version's normal form is made once, however many pairs it is in
    normal = cut_lineage(t.versions.select("bill", "version", "label", T.normalize_text("text").alias("text")))
    p = Sim.version_pairs(normal).select("bill", "kind", "from_label", "to_label", F.col("text_a").alias("a"), F.col("text_b").alias("b"))
    return alignment.difference_pct(p, "a", "b").drop("a", "b")


# --- token trust ---------------------------------------------------------------------------------------------------------
_PST = "[" + ",".join(f"'{w}'" for w in T.PROCEDURE_STOP_WORDS) + "]"
_DT = f"dt AS (SELECT bill AS doc, session AS label, ('0x'||substr(md5(bill),1,4))::BIGINT % 5 = 0 AS held, unnest(list_filter(list_distinct(regexp_extract_all(lower(text),'[a-z0-9]+')), lambda w: length(w)>=3 AND NOT list_contains({_PST}, w))) AS tok FROM texts)"


def _stats(name, where):
    return f"""{name}p AS (SELECT tok, label, count(*) AS n FROM dt {where} GROUP BY 1,2), {name} AS (SELECT tok, CAST(sum(n) AS BIGINT) AS support, round(greatest(log2(sum(n)) - sum(n*log2(n))/sum(n),0),9) AS entropy, max(n) AS topn FROM {name}p GROUP BY 1),
 {name}t AS (SELECT s.tok, support, entropy, min(p.label) AS top_label, round(topn/support,6) AS top_share FROM {name} s JOIN {name}p p ON p.tok=s.tok AND p.n=s.topn GROUP BY 1,2,3,topn)"""


def docs(t):
    return t.texts.select(F.col("bill").alias("doc"), F.col("session").alias("label"), "text")


@query("D25_token_stats", "texts", f"WITH {_DT}, {_stats('st', '')} SELECT *, support>=10 AND entropy<=0.5 AS trusted FROM stt")
def _(t):
    s = L.token_stats(L.doc_tokens(docs(t)))
    return s.withColumn("trusted", (F.col("support") >= 10) & (F.col("entropy") <= 0.5))


_SCORE = f"""{_DT}, {_stats('st', 'WHERE NOT held')}, vt AS (SELECT doc, top_label, count(*) AS v FROM dt JOIN (SELECT * FROM stt WHERE support>=10 AND entropy<=0.5) USING (tok) WHERE held GROUP BY 1,2),
 rk AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY v DESC, top_label) AS rn FROM vt), tl AS (SELECT doc, CAST(sum(v) AS BIGINT) AS used, max(top_label) FILTER (WHERE rn=1) AS winner, max(v) FILTER (WHERE rn=1) AS top, coalesce(max(v) FILTER (WHERE rn=2),0) AS second FROM rk GROUP BY 1),
 sc AS (SELECT t.bill AS doc, t.session AS label, used, winner, top, second, CASE WHEN used IS NULL THEN 'no_trusted_tokens' WHEN used<3 THEN 'insufficient_trusted_tokens' WHEN top<3 THEN 'insufficient_top_votes' WHEN top-second<2 THEN 'insufficient_margin' ELSE '' END AS reason FROM texts t LEFT JOIN tl ON tl.doc=t.bill WHERE ('0x'||substr(md5(t.bill),1,4))::BIGINT % 5 = 0)"""


def _split(t):
    d = docs(t).withColumn("held", L.held_out("doc"))
    return d.filter("NOT held"), d.filter("held")


def scored(t):
    train, test = _split(t)
    return L.score_rows(test, L.trusted(L.token_stats(L.doc_tokens(train)), 10, 0.5), min_tokens=3, min_top=3, min_margin=2)


@query("D26_row_votes", "texts", f"WITH {_SCORE} SELECT doc, used, top, second, reason, CASE WHEN reason='' THEN winner ELSE '' END AS predicted FROM sc")
def _(t):
    return scored(t).select("doc", "used", "top", "second", "reason", "predicted")


@query("D27_held_out_precision", "texts", f"WITH {_SCORE}, a AS (SELECT label, count(*) AS support, count(*) FILTER (WHERE reason='' AND winner=label) AS correct FROM sc GROUP BY 1), b AS (SELECT winner AS label, count(*) AS predicted_as FROM sc WHERE reason='' GROUP BY 1) SELECT coalesce(a.label,b.label) AS label, coalesce(support,0) AS support, coalesce(correct,0) AS correct, coalesce(predicted_as,0) AS predicted_as FROM a FULL JOIN b ON a.label=b.label")
def _(t):
    return L.precision_by_class(scored(t))


_GRID = [(5, 0.2), (10, 0.5), (20, 1.0), (50, 1.5)]
_SWEEP = " UNION ALL ".join(f"SELECT {s} AS min_support, {e}::DOUBLE AS max_entropy" for s, e in _GRID)


@query("I18_threshold_sweep", "texts", f"""WITH {_DT}, {_stats('st', 'WHERE NOT held')}, g AS ({_SWEEP}), tr AS (SELECT g.*, tok, top_label FROM g JOIN stt ON support>=min_support AND entropy<=max_entropy), vt AS (SELECT min_support, doc, label, top_label, count(*) AS v FROM dt JOIN tr USING (tok) WHERE held GROUP BY 1,2,3,4),
 rk AS (SELECT *, row_number() OVER (PARTITION BY min_support, doc ORDER BY v DESC, top_label) AS rn FROM vt), tl AS (SELECT min_support, doc, label, sum(v) AS used, max(top_label) FILTER (WHERE rn=1) AS winner, max(v) FILTER (WHERE rn=1) AS top, coalesce(max(v) FILTER (WHERE rn=2),0) AS second FROM rk GROUP BY 1,2,3)
 SELECT g.min_support, g.max_entropy, (SELECT count(*) FROM tr WHERE tr.min_support=g.min_support) AS trusted, (SELECT count(*) FROM tl WHERE tl.min_support=g.min_support AND used>=2 AND top>=2 AND top-second>=1) AS passed, (SELECT count(*) FROM tl WHERE tl.min_support=g.min_support AND used>=2 AND top>=2 AND top-second>=1 AND winner=label) AS correct FROM g""")
def _(t):
    train, test = _split(t)
    return L.sweep(train, test, _GRID)


# --- labels ------------------------------------------------------------------------------------------------------------------
def _pure(name, key, least=1, floor=0.6, where=""):
    return f"""{name}c AS (SELECT {key}, label, count(*) AS n FROM rec JOIN lab USING (key) {where} GROUP BY 1,2), {name}r AS (SELECT *, sum(n) OVER (PARTITION BY {key}) AS total, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, label) AS rn FROM {name}c),
 {name} AS (SELECT {key}, label, CAST(total AS BIGINT) AS total, n/total AS share FROM {name}r WHERE rn=1 AND total>={least} AND n/total>={floor})"""


@query("D28_label_purity", "texts", f"WITH {_REC}, {_pure('ph', 'h', 1, 0)}, {_pure('pc', 'cm', 1, 0)} SELECT 'head' AS field, h AS value, label, total, round(share,6) AS share FROM ph UNION ALL SELECT 'committee', cm, label, total, round(share,6) FROM pc")
def _(t):
    keyed = records(t).join(truth(t), "key")
    one = lambda c, name: L.purity(keyed.select(c, "label"), c).select(F.lit(name).alias("field"), F.col(c).alias("value"), "label", "total", F.round("share", 6).alias("share"))
    return one("h", "head").unionByName(one("cm", "committee"))


@query("D29_null_baseline", "texts", f"WITH {_REC}, te AS (SELECT key FROM rec JOIN (SELECT DISTINCT key FROM lab) USING (key) WHERE session='fr'), tp AS (SELECT label FROM lab WHERE key NOT IN (SELECT key FROM te) GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1) SELECT (SELECT label FROM tp) AS label, (SELECT count(DISTINCT key) FROM lab WHERE key IN (SELECT key FROM te) AND label=(SELECT label FROM tp)) AS hits, (SELECT count(*) FROM te) AS n, round((SELECT count(DISTINCT key) FROM lab WHERE key IN (SELECT key FROM te) AND label=(SELECT label FROM tp))/(SELECT count(*) FROM te),6) AS rate")
def _(t):
    test = records(t).filter("session = 'fr'").select("key").join(truth(t).select("key").distinct(), "key", "left_semi")
    return L.null_baseline(truth(t), test)


_NB = """nw AS (SELECT label, unnest(list_filter(string_split(h,' '), lambda w: w<>'')) AS w FROM rec JOIN lab USING (key)), nc AS (SELECT label, w, count(*) AS c FROM nw GROUP BY 1,2), np AS (SELECT label, count(*) AS prior FROM rec JOIN lab USING (key) GROUP BY 1), nt0 AS (SELECT label, sum(c) AS tot FROM nc GROUP BY 1),
 nv AS (SELECT count(DISTINCT w) AS v FROM nc), nh AS (SELECT DISTINCT h FROM rec), hw AS (SELECT h, unnest(list_filter(string_split(h,' '), lambda w: w<>'')) AS w FROM nh),
 ns AS (SELECT hw.h, np.label, sum(ln((coalesce(nc.c,0)+0.1)/(coalesce(nt0.tot,0)+0.1*(SELECT v FROM nv)))) + ln(any_value(prior)/(SELECT sum(prior) FROM np)) AS s FROM hw CROSS JOIN np LEFT JOIN nc ON nc.label=np.label AND nc.w=hw.w LEFT JOIN nt0 ON nt0.label=np.label GROUP BY 1,2),
 nr AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY s DESC, label DESC) AS rn FROM ns), nb AS (SELECT h, max(label) FILTER (WHERE rn=1) AS label, least(coalesce(max(s) FILTER (WHERE rn=1)-max(s) FILTER (WHERE rn=2),6),6) AS margin FROM nr GROUP BY 1)"""


@query("I12_naive_bayes", "texts", f"WITH {_REC}, {_NB} SELECT h, label, round(margin,6) AS margin FROM nb")
def _(t):
    r = records(t)
    return L.naive_bayes(r.select("h"), r.join(truth(t), "key").select("h", "label")).withColumn("margin", F.round("margin", 6))


_TAX = "tx AS (SELECT h2 AS name, CASE WHEN substr(md5(h2),2,1) < '8' THEN 'good' ELSE 'poor' END AS label FROM (SELECT DISTINCT h2 FROM rec) WHERE substr(md5(h2),1,1) < '4' AND length(h2)>=5 UNION SELECT string_split(h2,' ')[1], CASE WHEN substr(md5(string_split(h2,' ')[1]),2,1) < '8' THEN 'good' ELSE 'unheard' END FROM (SELECT DISTINCT h2 FROM rec) WHERE substr(md5(string_split(h2,' ')[1]),1,1) < '4' AND length(string_split(h2,' ')[1])>=5), txu AS (SELECT name, min(label) AS label FROM tx GROUP BY 1)"


def taxonomy(t):
    """A table of subject names for the match: the first word, or two, of some titles."""
    h = records(t).select("h2").distinct()
    pick = lambda c, other: F.when(F.substring(F.md5(c), 2, 1) < "8", "good").otherwise(other)
    two = h.filter((F.substring(F.md5("h2"), 1, 1) < "4") & (F.length("h2") >= 5)).select(F.col("h2").alias("name"), pick("h2", "poor").alias("label"))
    w = h.select(F.try_element_at(F.split("h2", " "), F.lit(1)).alias("name")).distinct()
    one = w.filter((F.substring(F.md5("name"), 1, 1) < "4") & (F.length("name") >= 5)).select("name", pick("name", "unheard").alias("label"))
    return two.unionByName(one)


_LEX = """lw AS (SELECT nt, list_filter(string_split(nt,' '), lambda w: w<>'') AS w FROM (SELECT DISTINCT nt FROM rec)), lg AS (SELECT nt, k AS size, i AS pos, array_to_string(w[i+1:i+k],' ') AS name FROM lw, unnest([1,2,3]) AS u(k), unnest(range(0,greatest(len(w)-k+1,0))) AS v(i)),
 lm AS (SELECT *, row_number() OVER (PARTITION BY nt ORDER BY size DESC, pos) AS rn FROM lg JOIN txu USING (name)), lx AS (SELECT nt, label, CASE WHEN size=1 THEN 0.81 WHEN size=2 THEN 0.89 WHEN size=3 THEN 0.94 ELSE 0.96 END AS conf FROM lm WHERE rn=1 AND NOT (size=1 AND pos>0))"""


@query("I13_lexical_match", "texts", f"WITH {_REC}, {_TAX}, {_LEX} SELECT nt, label, CAST(conf AS DOUBLE) AS conf FROM lx")
def _(t):
    return L.lexical_match(records(t), taxonomy(t), 3)


def vocabulary(t):
    return records(t).select("h").distinct().filter((F.substring(F.md5("h"), 1, 1) == "7") & (F.col("h") != "")).withColumn("label", F.lit("good"))


_TARGET = "tg AS (SELECT * FROM rec WHERE key NOT IN (SELECT key FROM lab)), sp AS (SELECT DISTINCT label FROM lab), fl AS (SELECT key, min(label) AS label FROM lab GROUP BY 1)"
_VOTES = f"""{_REC}, {_NB}, {_TAX}, {_LEX}, {_TARGET}, {_pure('ph', 'h', 1, 0.6, "WHERE h<>''")}, {_pure('pt', 'nt', 1, 0.6, "WHERE nt<>''")}, {_pure('pc', 'cm', 10, 0.6)},
 qt AS (SELECT key, tok FROM tt WHERE key IN (SELECT key FROM tg)), itt AS (SELECT key, tok FROM tt WHERE key IN (SELECT key FROM lab)), {near_sql('n1', 'qt', 'itt')}, qa AS (SELECT key, tok FROM atk WHERE key IN (SELECT key FROM tg)), ita AS (SELECT key, tok FROM atk WHERE key IN (SELECT key FROM lab)), {near_sql('n2', 'qa', 'ita')},
 rv AS (SELECT key, nb.label, 'headnb' AS route, 1 AS ro, margin/6 AS conf FROM tg JOIN nb USING (h) UNION ALL SELECT key, label, 'head', 2, share FROM tg JOIN ph USING (h) UNION ALL SELECT key, label, 'lex', 3, conf FROM tg JOIN lx USING (nt) WHERE label IN (SELECT label FROM sp) UNION ALL SELECT key, label, 'xtitle', 4, share FROM tg JOIN pt USING (nt)
 UNION ALL SELECT key, 'good', 'vocab', 5, 0.99 FROM tg WHERE substr(md5(h),1,1)='7' AND h<>'' UNION ALL SELECT n1.key, fl.label, 'near', 6, sim FROM n1 JOIN fl ON fl.key=n1.item UNION ALL SELECT n2.key, fl.label, 'abs', 7, sim FROM n2 JOIN fl ON fl.key=n2.item UNION ALL SELECT key, label, 'cmte', 8, share FROM tg JOIN pc USING (cm)),
 rl AS (SELECT key, label, count(*) AS agree FROM rv GROUP BY 1,2), rb AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY agree DESC, label) AS rn FROM rl), dc AS (SELECT key, label, agree, (SELECT sum(conf) FROM rv WHERE rv.key=rb.key)+agree AS conf, (SELECT string_agg(route,'+' ORDER BY ro) FROM rv WHERE rv.key=rb.key) AS routes FROM rb WHERE rn=1)"""


@query("I14_label_vote", "texts", f"WITH {_VOTES} SELECT key, label, agree, round(conf,6) AS conf, routes FROM dc")
def _(t):
    r = records(t)
    targets = r.select("key").join(truth(t).select("key").distinct(), "key", "left_anti")
    d = L.decide(L.route_votes(r, title_tokens(t), text_tokens(t), truth(t), vocabulary(t), taxonomy(t), cmte_min=10, targets=targets))
    return d.withColumn("conf", F.round("conf", 6))


@query("I15_self_training")
def _(t):
    out = L.self_training(records(t), title_tokens(t), text_tokens(t), truth(t), vocabulary(t), taxonomy(t), accept=2.0, promote=4.0, rounds=3, cmte_min=10)
    return out.select("key", "label", F.round("conf", 6).alias("conf"), "routes")


@query("I16_safe_folds", "texts", f"WITH {_REC} SELECT key, session||'#'||nt AS grp, ('0x'||substr(md5(session||'#'||nt),1,6))::BIGINT % 4 AS fold FROM rec")
def _(t):
    return L.fold_groups(records(t), 4)


_EDGES = f"""{_TB}, m AS (SELECT a.bill, b.bill AS other, b.pos FROM tw a JOIN tw b ON a.session=b.session AND a.head=b.head AND a.bill[1]<>b.bill[1] WHERE a.title=b.title OR len(list_intersect(a.w,b.w))/(len(a.w)+len(b.w)-len(list_intersect(a.w,b.w))) >= 0.6),
 e AS (SELECT bill AS src, max_by(other, pos) AS dst FROM m GROUP BY 1), two AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), reach(bill, grp) AS (SELECT DISTINCT bill, bill FROM titles UNION SELECT r.bill, two.dst FROM reach r JOIN two ON two.src = r.grp),
 g AS (SELECT bill, min(grp) AS grp FROM reach GROUP BY 1)"""


def companion_edges(t):
    return Sim.companions(title_bills(t)).select(F.col("bill").alias("src"), F.col("companion").alias("dst"))


@query("I16_companion_groups", "titles", f"WITH RECURSIVE {_EDGES} SELECT bill, grp FROM g")
def _(t):
    """Bills that companion links join, however long the chain, under their smallest bill."""
    return folds.companion_groups(t.titles, companion_edges(t), "bill")


@query("I16_companion_folds", "titles", f"WITH RECURSIVE {_EDGES}, s AS (SELECT grp, count(*) AS n FROM g GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS records, count(*) AS groups, max(n) AS largest, CAST(0 AS BIGINT) AS crossing, TRUE AS balanced FROM s")
def _(t):
    """Folds of whole companion groups: no link crosses them, and they differ by at most the largest group."""
    edges = cut_lineage(companion_edges(t))
    return folds.fold_report(folds.balanced_folds(folds.companion_groups(t.titles, edges, "bill"), 4, "bill"), edges, "bill")


def evaluation(t, held):
    """Predictions for labelled records of one part, from the labels of the other parts; ``held`` marks the part."""
    r = records(t).withColumn("held", held)
    inside = r.filter("held").select("key")
    seed = truth(t).join(inside, "key", "left_anti")
    votes = L.route_votes(r.drop("held"), title_tokens(t), text_tokens(t), seed, vocabulary(t), taxonomy(t), cmte_min=10, targets=inside.join(truth(t).select("key").distinct(), "key", "left_semi"))
    return L.judged(L.decide(votes), truth(t))


_COLD = _VOTES.replace(_REC, _REC.replace("lab AS (", "lab_all AS (", 1) + ", lab AS (SELECT * FROM lab_all WHERE key NOT IN (SELECT key FROM rec WHERE session='fr'))").replace(
    "tg AS (SELECT * FROM rec WHERE key NOT IN (SELECT key FROM lab))", "tg AS (SELECT * FROM rec WHERE session='fr' AND key IN (SELECT key FROM lab_all))") + ", jd AS (SELECT dc.*, EXISTS (SELECT 1 FROM lab_all l WHERE l.key=dc.key AND l.label=dc.label) AS ok FROM dc)"


def _held():
    return F.col("session") == "fr"


@query("I17_cold_evaluation", "texts", f"WITH {_COLD} SELECT routes, count(*) AS n, count(*) FILTER (WHERE ok) AS hits FROM jd GROUP BY 1")
def _(t):
    return L.route_accuracy(evaluation(t, _held()))


@query("E17_precision_cutoff", "texts", f"WITH {_COLD}, lv AS (SELECT round(conf,6) AS c, count(*) AS n, count(*) FILTER (WHERE ok) AS h FROM jd GROUP BY 1), cu AS (SELECT c, sum(n) OVER (ORDER BY c DESC) AS cn, sum(h) OVER (ORDER BY c DESC) AS ch FROM lv) SELECT min(c) AS cutoff, CAST(max(cn) AS BIGINT) AS accepted FROM cu WHERE ch/cn >= 0.8")
def _(t):
    return L.precision_cutoff(evaluation(t, _held()), 0.8)


@query("I23_two_tiers")
def _(t):
    cold = evaluation(t, _held())
    internal = evaluation(t, F.conv(F.substring(F.md5(F.concat_ws("#", "session", "nt")), 1, 6), 16, 10).cast("bigint") % 4 == 0)
    return L.two_tier_cutoffs(cold, internal, 3.2, strong=0.75, weak=0.70)


@query("I19_canonical_spelling", "titles", f"WITH s AS (SELECT CASE id % 5 WHEN 0 THEN upper(name) WHEN 1 THEN replace(name,' ','-') ELSE name END AS name FROM titles), p AS (SELECT name, {S.spelling('name')} AS key, count(*) AS n FROM s GROUP BY 1,2), b AS (SELECT key, name AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, name) AS rn FROM p) WHERE rn=1) SELECT p.name, p.key, p.n, canonical FROM p JOIN b USING (key)")
def _(t):
    k = F.col("id") % 5
    names = t.titles.select(F.when(k == 0, F.upper("name")).when(k == 1, F.replace("name", F.lit(" "), F.lit("-"))).otherwise(F.col("name")).alias("raw"))
    return L.canonical_spelling(names, "raw")
