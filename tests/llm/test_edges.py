"""Every operator and stage with the rows and columns that break things: large and string ids, nulls, blanks, clashing names, empty tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import chat, exact_dedup, licenses, minhash, mixing, packing, quality, secrets, sharding, tokens
from sparkloom.llm.common import shared_dir

BIG = 2**53 + 1
SECRET = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
TEXT = f"A first sentence of some length.\n{SECRET}.\nReleased under the MIT License.\nAnother sentence, and it is the last one."
BLANK = " " * 2_000_000 + "x." + "\n" * 1_000_000
#: Names that helper columns have or had.
NAMES = """c0 c1 id src x take tied cut_q cut_i want size rows copy __i __s __x __n __c __q __copy passed _passed __p t c had kept gi gt n node sig whole bands band key
    text_key group_id component b1 b2 chunk chunks digest gen shard keep_id keep_gen h0 i0 __id __kept __n2 __gone filter length cell piece nth tier window_no step_group offset start
    n_tokens rule end proof license line saved kept_share shard_after_growth item items chat role pos call_id""".split()
KINDS = {"long": "doc_id long", "string": "doc_id string"}


def ids(kind):
    out = [BIG, BIG + 1, None, 5, 5, 7, 8, 9, 10, 11]
    return [None if i is None else f"k{i}" for i in out] if kind == "string" else out


def docs(spark, kind):
    texts = [TEXT, TEXT, TEXT, "", None, BLANK, BLANK, "Hello there, the world.", TEXT + " more", " \n\t"]
    rows = [(i, t, "en", None if k % 3 == 0 else f"s{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids(kind), texts))]
    df = spark.createDataFrame(rows, f"{KINDS[kind]}, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])


ROW_BY_ROW = {  # operator -> name of its id column; one row a row
    "tokens": lambda d: tokens.count_tokens(d),
    "shards": lambda d: sharding.assign_shards(d, "doc_id", sharding.SHARDS).select("doc_id", "shard"),
    "packing": lambda d: packing.pack_texts(d).where("start = 0"),
}
FINDING = {"secrets": secrets.scan_secrets, "licenses": licenses.scan_licenses}
KEEPING = {"quality": lambda d: quality.clean_lines(d).drop("kept_share"), "exact": exact_dedup.drop_exact_copies, "near": minhash.drop_near_copies, "mix": lambda d: mixing.mix(d).drop("copy")}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("name", ROW_BY_ROW)
def test_ids_of_all_rows_come_through(spark, name, kind):
    df = docs(spark, kind).coalesce(1)  # nulls and large ids in one batch
    out = ROW_BY_ROW[name](df)
    assert out.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(ids(kind))
    assert ROW_BY_ROW[name](df.limit(0)).count() == 0


def test_tokens_of_blank_runs(spark):
    enc = tokens.encoding(tokens.read_ranks())
    texts = {1: BLANK, 2: "\t" * 3_000_000, 3: "a" * 2_000_000, 4: "\n \n" * 500_000 + "end", 5: "=" * 1_000_000}
    got = {r[0]: r[1] for r in tokens.count_tokens(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    find = tokens.split_pattern().findall
    assert got == {i: sum(len(enc._encode_single_piece(p)) for p in find(t)) for i, t in texts.items()}
    few = {i: t[:1500] for i, t in texts.items()}
    got = {r[0]: r[1] for r in tokens.count_tokens(spark.createDataFrame(list(few.items()), "doc_id long, text string")).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in few.items()}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("name", FINDING)
def test_findings_carry_the_ids(spark, name, kind):
    df = docs(spark, kind).coalesce(1)
    k = ids(kind)
    assert Counter(r["doc_id"] for r in FINDING[name](df).collect()) == Counter([k[0], k[1], None, k[8]])
    assert FINDING[name](df.limit(0)).count() == 0


@pytest.mark.parametrize("name, kind", [(n, k) for n, k in zip(KEEPING, ("long", "string", "string", "long"))])
def test_clashing_columns_stay_as_they_are(spark, name, kind):
    df = docs(spark, kind).coalesce(1)
    if name == "quality":
        df = df.drop("kept_share")
    if name == "mix":
        df = df.drop("copy")
    out = KEEPING[name](df)
    assert out.columns == df.columns
    rows = out.collect()
    own = [n for n in NAMES if n in df.columns]
    assert rows and all(r[n] == f"own {n}" for r in rows for n in own)
    k = ids(kind)
    kept = Counter(r["doc_id"] for r in rows)
    if name == "exact":  # of the texts TEXT and BLANK one row each, of the others all
        assert len(rows) == 7 and kept[k[3]] == 2 and len({r["text"] for r in rows if r["doc_id"] in (k[0], k[1], None)}) == 1
    elif name == "near":  # a null id is like no other row
        assert len(rows) == 7 and kept[None] == 1 and kept[k[0]] + kept[k[1]] + kept[k[8]] == 1 and kept[k[5]] + kept[k[6]] == 1
    elif name == "mix":
        assert len(rows) == 10 and {r["source"] for r in rows} == {None, "s1", "s2"}
    else:
        assert kept == Counter([k[0], k[1], None, k[5], k[6], k[7], k[8]])
    assert KEEPING[name](df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", KINDS)
def test_groups_carry_the_ids(spark, kind):
    df, k = docs(spark, kind).coalesce(1), ids(kind)
    least = min(x for x in (k[0], k[1], k[8]))
    near = [tuple(r) for r in minhash.near_groups(df).collect()]
    blank = min(k[5], k[6])
    assert Counter(near) == Counter([(x, least, x == least) for x in (k[0], k[1], k[8])] + [(x, blank, x == blank) for x in (k[5], k[6])])
    copies = exact_dedup.exact_copies(df).collect()
    assert len(copies) == 3 and all(type(r["doc_id"]) in (type(k[0]), type(None)) for r in copies)


def test_chats_carry_the_ids(spark):
    for conv in ([BIG, BIG + 1, None], ["a", "b", None]):
        kind = "long" if conv[0] == BIG else "string"
        turns = spark.createDataFrame([(c, t, r, x) for c in conv for t, (r, x) in enumerate([("user", BLANK), ("assistant", ""), ("user", None)])], f"conv_id {kind}, turn long, role string, text string")
        turns = turns.select("*", *[F.lit(n).alias(n) for n in NAMES if n != "role"]).coalesce(1)
        assert Counter(r["conv_id"] for r in chat.format_chats(*chat.from_turns(turns), chat.SCHEMAS).collect()) == Counter(conv)
        assert Counter(r["conv_id"] for r in chat.format_chats(*chat.from_messages(turns), chat.SCHEMAS).collect()) == Counter(conv)


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_clashing_columns(spark, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    df = docs(spark, "long").coalesce(1)
    out = f(spark, df, "")
    assert out.count() >= 5 and (stage == "packing" or out.columns == df.columns)
    if stage != "packing":
        assert all(r[n] == f"own {n}" for r in out.collect() for n in NAMES)


def test_no_shared_folder_is_made_up_on_a_cluster(monkeypatch):
    class Context:
        master = "local-cluster[2,1,1024]"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        shared_dir(Session())
