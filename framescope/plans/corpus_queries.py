"""Queries for corpus preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from framescope.functions import arrays as A
from framescope.functions import scalar as S
from framescope.operators import corpus, layout
from framescope.plans import views as V
from framescope.plans.registry import draw_sql, query, r6, s6
from framescope.plans.views import with_views

ID = ["stream_id", "frame_index"]


@query("k01_balanced_choice", with_views("clips", f"""SELECT lang, gender, client, path FROM (SELECT *, row_number() OVER (PARTITION BY lang, gender ORDER BY {draw_sql("concat_ws('/', lang, gender, client)", 3, 'client')}, client) AS r FROM one)
 WHERE r<=2 AND lang IN (SELECT lang FROM one GROUP BY 1 HAVING least(count(*) FILTER (WHERE gender='female'), count(*) FILTER (WHERE gender='male')) >= 2)""",
    f"one AS (SELECT lang, gender, client, min_by(path, ({draw_sql('path', 3, 'clip')}, path)) AS path FROM clips WHERE gender IS NOT NULL GROUP BY ALL)"))
def k01(spark, sf):
    return corpus.balanced_choice(V.clips(spark, sf), 4, 3)


@query("k02_sequences", with_views("tel", f"SELECT stream_id, frame_index//8 AS sequence, {s6('sum(value*(frame_index%8+1))', 'moment')} FROM tel GROUP BY ALL HAVING count(*)=8"))
def k02(spark, sf):
    s = corpus.sequences(V.telemetry(spark, sf), "value", 8)
    return s.select("stream_id", "sequence", r6(A.total(F.transform("values", lambda x, i: x * (i + 1))), "moment"))


@query("k03_context_windows", with_views("tel", f"SELECT t.stream_id, s AS sequence, {s6('sum(value*(frame_index-(s*8-2)+1))', 'moment')} FROM (SELECT *, unnest(range(greatest(0, (frame_index-3)//8), (frame_index+2)//8 + 1)) AS s FROM tel) t GROUP BY ALL HAVING count(*)=13"))
def k03(spark, sf):
    s = corpus.context_windows(V.telemetry(spark, sf), "value", 8, 2, 3)
    return s.select("stream_id", "sequence", r6(A.total(F.transform("values", lambda x, i: x * (i + 1))), "moment"))


@query("k04_fixed_delay", with_views("tel", f"SELECT a.stream_id, a.frame_index, a.packet_bytes, {s6('b.value', 'value')} FROM tel a JOIN tel b ON b.stream_id=a.stream_id AND b.frame_index=a.frame_index+3"))
def k04(spark, sf):
    t = V.telemetry(spark, sf)
    out = corpus.align(t.select(*ID, "packet_bytes"), t.select(*ID, "value"), 3)
    return out.select(*ID, "packet_bytes", r6("value", "value"))


def items(spark, sf):
    """Frames as clips of a corpus: one corpus per stream."""
    return V.pcm_frames(spark, sf).select(F.col("stream_id").alias("corpus"), F.col("frame_index").alias("item_index"), "pcm")


@query("k05_cross_fade", with_views("smp", f"""SELECT stream_id AS corpus, frame_index AS item_index, {s6("sum(v*(n+1))", 'moment')} FROM (
 SELECT a.stream_id, a.frame_index, a.n, CASE WHEN a.n<8 THEN a.x*(0.5e0+0.5e0*cos((7-a.n)*pi()/8)) + coalesce(b.x,0)*(0.5e0+0.5e0*cos(a.n*pi()/8)) ELSE a.x END AS v
 FROM smp a LEFT JOIN smp b ON b.stream_id=a.stream_id AND b.frame_index=a.frame_index-1 AND b.n=a.n+56 WHERE a.n<56) GROUP BY ALL"""))
def k05(spark, sf):
    f = corpus.cross_fade(items(spark, sf), "pcm", 8)
    return f.select("corpus", "item_index", r6(A.total(F.transform("faded", lambda x, i: x * (i + 1))), "moment"))


@query("k06_concat_offsets", with_views("tel", 'SELECT stream_id, frame_index, (sum(packet_bytes) OVER (PARTITION BY stream_id ORDER BY frame_index) - packet_bytes)::bigint AS "offset" FROM tel'))
def k06(spark, sf):
    t = V.telemetry(spark, sf).select(*ID, "packet_bytes")
    return corpus.concat_offsets(t, "packet_bytes", ("stream_id",), "frame_index").select(*ID, F.col("offset").cast("long").alias("offset"))


_U = lambda n: draw_sql("doc_id", 17, n)


@query("k08_augmentation", f"""SELECT doc_id, (CASE WHEN {_U('start?')}<0.75e0 THEN 0 ELSE least(floor(-1000*ln(greatest({_U('start')},1e-12))), 8000) END)::bigint AS start,
 {s6(f"CASE WHEN {_U('mute')}<0.01e0 THEN 0 ELSE pow(10e0,(-30+floor({_U('speech')}*40))/20)*(CASE WHEN {_U('sign')}<0.5e0 THEN -1 ELSE 1 END)*(CASE WHEN {_U('faint')}<0.05e0 THEN 0.01e0 ELSE 1 END) END", 'speech_gain')},
 {_U('clip')}<0.25e0 AS clips, {_U('quantise')}<0.5e0 AS quantises, {_U('clean')}<0.25e0 AS stays_clean, {s6(_U('dither') + '-0.5e0', 'dither')} FROM documents""")
def k08(spark, sf):
    d = corpus.augmentation(V.table(spark, sf, "documents").select("doc_id"), F.col("doc_id"), 17, 8000)
    return d.select("doc_id", "start", r6("speech_gain", "speech_gain"), "clips", "quantises", "stays_clean", r6("dither", "dither"))


_W = lambda n: draw_sql("stream_id*100000+frame_index", 17, n)


@query("k08_augmented_signal", with_views("smp", f"""SELECT stream_id, frame_index, {s6('sum(v*v)', 'energy')} FROM (SELECT stream_id, frame_index, CASE WHEN {_W('clean')}<0.25e0 THEN x WHEN {_W('quantise')}<0.5e0 THEN floor(0.5e0+c) ELSE c END AS v FROM (
 SELECT *, CASE WHEN {_W('clip')}<0.25e0 THEN greatest(-32767e0, least(y, 32767e0)) ELSE y END AS c FROM (SELECT *, CASE WHEN n<st THEN 0 ELSE x*g END + z*ng*g AS y FROM (
 SELECT a.stream_id, a.frame_index, a.n, a.x, b.x AS z, st, g, ng FROM smp a JOIN smp b ON b.stream_id=a.stream_id AND b.frame_index=a.frame_index-1 AND b.n=a.n
 JOIN (SELECT stream_id, frame_index, CASE WHEN {_W('start?')}<0.75e0 THEN 0 ELSE least(floor(-1000*ln(greatest({_W('start')},1e-12))), 64) END AS st,
  CASE WHEN {_W('mute')}<0.01e0 THEN 0 ELSE pow(10e0,(-30+floor({_W('speech')}*40))/20)*(CASE WHEN {_W('sign')}<0.5e0 THEN -1 ELSE 1 END)*(CASE WHEN {_W('faint')}<0.05e0 THEN 0.01e0 ELSE 1 END) END AS g,
  (CASE WHEN {_W('no noise')}<0.5e0 THEN 0 ELSE pow(10e0,(-40+{_W('noise1')}*25+{_W('noise2')}*15)/20) END)*(CASE WHEN {_W('low noise')}<1e0/12 THEN 0.03e0 ELSE 1 END) AS ng FROM pcm) d ON d.stream_id=a.stream_id AND d.frame_index=a.frame_index)))) GROUP BY ALL"""))
def k08b(spark, sf):
    f = layout.windowed(V.pcm_frames(spark, sf), {"noise": lambda w: F.lag("pcm").over(w)}, before=1).where(F.col("noise").isNotNull())
    f = corpus.augmentation(f, F.col("stream_id") * 100000 + F.col("frame_index"), 17, 64)
    return corpus.apply_augmentation(f, "pcm", "noise").select(*ID, r6(A.energy("mixed"), "energy"))


@query("k11_split", f"SELECT doc_id, CASE WHEN {draw_sql('doc_id', 23, 'split')}<0.95e0 THEN 'train' ELSE 'test' END AS part FROM documents")
def k11(spark, sf):
    return corpus.split(V.table(spark, sf, "documents").select("doc_id"), F.col("doc_id"), 23)


@query("t05_seeded_sample", f"SELECT doc_id FROM documents ORDER BY {draw_sql('doc_id', 29, 'sample')}, doc_id LIMIT 50")
def t05(spark, sf):
    return corpus.sample(V.table(spark, sf, "documents").select("doc_id"), "doc_id", 50, 29)


@query("j12_random_noise", with_views("pcm", f"""SELECT t.stream_id, t.frame_index, noise_id::bigint AS noise_id, {s6('sum(pow(t.x+n.x,2))', 'energy')} FROM (SELECT p.*, floor({draw_sql('p.stream_id*100000+p.frame_index', 31, 'noise')}*(SELECT count(*) FROM embeddings))::bigint AS noise_id, i, pcm[i] AS x FROM pcm p, range(1,65) r(i)) t
 JOIN (SELECT vec_id, i, embedding[i]::double AS x FROM embeddings, range(1,65) r(i)) n ON n.vec_id=t.noise_id AND n.i=t.i GROUP BY ALL"""))
def j12(spark, sf):
    pool = V.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("pool_index"), F.col("embedding").cast("array<double>").alias("noise"))
    f = corpus.random_partner(V.pcm_frames(spark, sf), pool, F.col("stream_id") * 100000 + F.col("frame_index"), 31, "noise")
    return f.select(*ID, F.col("pool_index").alias("noise_id"), r6(A.energy(A.add("pcm", "noise")), "energy"))


def loss_rows(spark, sf):
    return V.table(spark, sf, "events").select(F.col("event_id").alias("seq"), (F.col("event_type") == "error").cast("int").alias("lost"))


@query("j13_loss_for_sequences", f"""SELECT s.doc_id, j AS position, e.event_id AS seq, (e.event_type='error')::int AS lost FROM (SELECT doc_id, floor({draw_sql('doc_id', 37, 'offset')}*((SELECT count(*) FROM events)-10))::bigint AS o FROM documents) s, range(0,10) r(j) JOIN events e ON e.event_id=s.o+j""")
def j13(spark, sf):
    seqs = V.table(spark, sf, "documents").select("doc_id")
    rows = corpus.loss_for_sequences(seqs, loss_rows(spark, sf), F.col("doc_id"), 10, 37)
    return rows.select("doc_id", F.col("position").cast("long").alias("position"), (F.col("loss_offset") + F.col("position")).alias("seq"), "lost")


_KEY = "concat_ws('/', doc_id::varchar, j::varchar)"
_D = lambda n: draw_sql(_KEY, 41, n)


@query("k10_masked_features", f"""SELECT doc_id, j AS position, {s6('kept*(2*burst-1)', 'state')}, {s6('kept*burst*1 + kept*burst*2 + kept*3 + kept*4', 'total')} FROM (SELECT *, 1-(1-(1-lost)*({_D('extra')}>0.02e0)::int)*({_D('break')}>0.1e0)::int AS kept, ({_D('burst')}>0.1e0)::int AS burst FROM (
 SELECT s.doc_id, j, (e.event_type='error')::int AS lost FROM (SELECT doc_id, floor({draw_sql('doc_id', 37, 'offset')}*((SELECT count(*) FROM events)-10))::bigint AS o FROM documents) s, range(0,10) r(j) JOIN events e ON e.event_id=s.o+j))""")
def k10(spark, sf):
    seqs = V.table(spark, sf, "documents").select("doc_id", A.lits([1, 2, 3, 4]).alias("f"))
    rows = corpus.loss_for_sequences(seqs, loss_rows(spark, sf), F.col("doc_id"), 10, 37)
    m = corpus.mask_features(rows, F.col("doc_id"), 41, "f", 2)
    return m.select("doc_id", F.col("position").cast("long").alias("position"), r6("state", "state"), r6(A.total("masked"), "total"))


_KIND = "CASE WHEN l_linenumber%4=3 THEN 'lfe' WHEN l_linenumber%2=0 THEN 'coupled' ELSE 'mono' END"
_OFF = "greatest(0, least(20000, trunc(trunc((128000-2000*(2*c+m)-3750*l)::double/(2*c+m))/2)))::bigint"
_RATE = f"trunc(256::bigint*(128000-3750*l-{_OFF}*(c+m)-2000*(2*c+m))::double/(256*m+512*c+32*l))::bigint"


@query("k13_surround_rates", f"""SELECT group_id, kind, greatest(500, CASE kind WHEN 'coupled' THEN 4000+greatest(0, {_OFF}+(({_RATE})*512>>8)) WHEN 'mono' THEN 2000+greatest(0, {_OFF}+{_RATE}) ELSE greatest(0, 3750+(({_RATE})*32>>8)) END)::bigint AS rate FROM (
 SELECT DISTINCT l_orderkey AS group_id, {_KIND} AS kind FROM lineitem) JOIN (SELECT l_orderkey AS group_id, count(*) FILTER (WHERE k='coupled') AS c, count(*) FILTER (WHERE k='mono') AS m, count(*) FILTER (WHERE k='lfe') AS l FROM (SELECT l_orderkey, {_KIND} AS k FROM lineitem) GROUP BY 1) USING (group_id) WHERE c+m>0""")
def k13(spark, sf):
    n = F.col("l_linenumber")
    kind = F.when(n % 4 == 3, "lfe").when(n % 2 == 0, "coupled").otherwise("mono")
    li = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("group_id"), kind.alias("kind"))
    return corpus.surround_kind_rates(li, 128000)
