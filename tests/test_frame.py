import json
import random

import pytest
from pyspark.sql import functions as F

import quillspark as q
from quillspark import sources, streaming
from quillspark.functions.models import Hashed
from quillspark.plans import RULES, Node, Plan, chunked, hierarchical, take_head_tail

ROWS = [{"id": i, "text": f"t{i}", "grp": i % 3} for i in range(9)]


def test_rewrites_save_calls(spark, tmp_path):
    def run(rules):
        log = tmp_path / "-".join(["r", *rules])
        log.mkdir()

        def answer(prompt):
            import uuid

            (log / uuid.uuid4().hex).write_text(prompt)
            return {"label": prompt}

        frame = q.read_rows(ROWS).map(prompt="{{ input.text }}", output={"label": "string"}, model=Hashed(answer), keep_failed=True).code_filter(lambda r: r["grp"] == 0, reads=["grp"]).sample(method="first", samples=2, order=["id"])
        df = frame.steps.rewritten(rules).compile(frame.source(spark))
        return sorted((r.id, r.label) for r in df.collect()), len(list(log.iterdir()))

    (plain, many), (fast, few) = run([]), run(list(RULES))
    assert plain == fast == [(0, "t0"), (3, "t3")] and few < many
    with pytest.raises(ValueError):
        Plan().rewritten(["none"])


@pytest.mark.parametrize("seed", range(5))
def test_random_chains_are_equal_with_and_without_rules(spark, seed):
    r = random.Random(seed)
    plan = Plan()
    for k in range(6):
        pick = r.randrange(4)
        if pick == 0:
            plan = plan.then(Node("map", f"m{k}", {"prompt": "{{ input.text }}", "output": {f"o{k}": "integer"}, "model": Hashed(), "keep_failed": True}))
        elif pick == 1:
            plan = plan.then(Node("code_filter", f"f{k}", {"code": f"id % {r.randint(2, 5)} <> 1"}))
        elif pick == 2:
            plan = plan.then(Node("code_map", f"c{k}", {"code": {f"c{k}": F.col("id") * k}, "reads": ["id"]}))
        else:
            plan = plan.then(Node("sample", f"s{k}", {"method": "first", "samples": r.randint(3, 8), "order": ["id"]}))
    df = spark.createDataFrame([(x["id"], x["text"]) for x in ROWS], "id int, text string")
    a, b = (sorted((x.asDict() for x in p.compile(df).collect()), key=repr) for p in (plan, plan.rewritten()))
    assert [dict(sorted(x.items())) for x in a] == [dict(sorted(x.items())) for x in b]


def test_frame(spark, tmp_path):
    frame = q.read_rows(ROWS).code_filter("grp < 2").add_uuid(of=["id"])
    assert frame.count(spark) == 6 and frame.collect(spark)[0].keys() == {"id", "text", "grp", "add_uuid_id"}
    assert "code_filter_1 [code_filter] sel reads {grp}" in frame.explain()
    assert Plan().then(Node("unnest_columns", "u", {"key": "d", "keys": ["a"]})).then(Node("split", "s", {"key": "d"})).validate() == ["s reads d, which was removed"]
    with pytest.raises(ValueError):
        Node("nothing", "n")
    with pytest.raises(AttributeError):
        frame.nothing
    path = f"{tmp_path}/rows.json"
    open(path, "w").write(json.dumps(ROWS))
    saved = q.read_json(path).code_filter("grp = 1").split("text", delimiter="t", id_of=["id"])
    again = q.Frame.from_yaml(saved.to_yaml())
    assert again.count(spark) == saved.count(spark) == 3 and again.to_config() == saved.to_config()
    joined = q.read_rows(ROWS).equijoin(q.read_rows([{"k": 1, "n": "one"}]), left_id="id", right_id="k", compare="l_grp = r_k")
    assert joined.count(spark) == 3


def test_checkpoints_stop_second_payments(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def answer(prompt):
        import uuid

        (log / uuid.uuid4().hex).write_text(prompt)
        return {"label": prompt}

    q.settings.checkpoint_folder = str(tmp_path / "store")
    try:
        model = Hashed(answer)
        make = lambda: q.read_rows(ROWS).map(prompt="{{ input.text }}", output={"label": "string"}, model=model)
        assert make().count(spark) == 9 and make().add_uuid(of=["id"]).count(spark) == 9
        assert len(list(log.iterdir())) == 9
    finally:
        q.settings.checkpoint_folder = None


def test_plan_expansions(spark):
    node = Node("map", "m", {"prompt": "{{ input.text }}", "output": {"label": "string"}, "model": Hashed(lambda p: {"label": p})})
    cut = Plan(take_head_tail(node, "text", 1, 1)).compile(spark.createDataFrame([("a b c d",)], "text string"))
    assert cut.first().label == "a ... d"
    reduce = Node("code_reduce", "r", {"code": {"n": F.count("*")}, "keys": "id", "order": ["id"]})
    long = chunked(node, "text", num_tokens=2, doc_id="id", reduce=reduce)
    assert Plan(long).compile(spark.createDataFrame([(1, "a b c d e")], "id int, text string")).first().n == 3
    two = hierarchical(Node("reduce", "r", {"keys": "g", "output": {"s": "string"}, "model": Hashed(lambda p: {"s": p}), "prompt": "{% for x in inputs %}{{ x.s }}{% endfor %}", "order": ["h"]}), ["h"])
    df = spark.createDataFrame([("k", 1, "a"), ("k", 1, "b"), ("k", 2, "c")], "g string, h int, s string")
    assert sorted(Plan(two).compile(df).first().s) == ["a", "b", "c"]


def test_sources(spark, tmp_path):
    (tmp_path / "d/sub").mkdir(parents=True)
    (tmp_path / "d/a.txt").write_text("one")
    (tmp_path / "d/sub/b.txt").write_text("two")
    (tmp_path / "d/.hidden").write_text("no")
    (tmp_path / "d/c.bin").write_bytes(b"a\0b")
    got = sources.read_directory(spark, str(tmp_path / "d"))
    assert sorted((r.filename, r.text) for r in got.collect()) == [("a.txt", "one"), ("b.txt", "two")]
    (tmp_path / "x.csv").write_text('a,b\n1,"x, y"\n2,\n')
    assert [tuple(r) for r in sources.read_csv(spark, str(tmp_path / "x.csv")).collect()] == [("1", "x, y"), ("2", None)]
    df = sources.from_rows(spark, [{"a": 1}, {"a": 2, "b": ["p"]}])
    for kind in ("json", "csv", "parquet"):
        sources.write(df, f"{tmp_path}/out.{kind}")
        assert getattr(spark.read.option("header", True), kind)(f"{tmp_path}/out.{kind}").count() == 2
    with pytest.raises(ValueError):
        sources.write(df, f"{tmp_path}/out.txt")
    parsed = sources.parse(spark.createDataFrame([("a,b\n1,2\n3,4",)], "raw string"), [{"function": "csv_to_rows", "input_key": "raw", "output_key": "row"}])
    assert [json.loads(r.row) for r in parsed.collect()] == [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}]
    assert sources.with_ordinal(spark.read.parquet(f"{tmp_path}/out.parquet")).select("__ord.row").count() == 2


def test_streaming(spark, tmp_path):
    source = spark.createDataFrame([(i, "ab"[i % 2], i) for i in range(10)], "id long, k string, v long")
    source.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = streaming.read_files(spark, f"{tmp_path}/in", source.schema, files_per_trigger=1)
    plan = Plan().then(Node("code_filter", "f", {"code": "id > 3"})).then(Node("code_map", "c", {"code": {"w": F.col("v") * 2}}))
    streaming.run_available(streaming.apply(plan, stream), f"{tmp_path}/out", f"{tmp_path}/c1")
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.sum("w")).first()[0] == 2 * sum(range(4, 10))
    with pytest.raises(ValueError):
        streaming.apply(Plan().then(Node("sample", "s", {"method": "first", "samples": 1, "order": ["id"]})), stream)
    last = {}
    folded = streaming.fold(stream, keys=["k"], state="total long", output="k string, total long", step=lambda s, rows: ((s[0] if s else 0) + int(rows["v"].sum()),), finish=lambda key, s: {"k": key[0], "total": s[0]})
    streaming.run_batches(folded, lambda df, _: last.update({r.k: r.total for r in df.collect()}), f"{tmp_path}/c2")
    assert last == {"a": 20, "b": 25}
