import pytest
from pyspark.sql import functions as F

from quillspark.functions.models import Call, CallTable, Expressions, Gleaning, Hashed
from quillspark.functions.schema import parse, parse_schema
from quillspark.functions.templates import Template, TemplateError
from quillspark.functions.text import absolute_links, cut_middle, to_markdown
from quillspark.operators import rows


def test_types():
    kind = parse("list[{Name: str, Kinds: list[enum[A, b]]}]")
    assert kind.spark().simpleString() == "array<struct<Name:string,Kinds:array<string>>>"
    assert kind.accepts([{"Name": "x", "Kinds": ["A"]}]) and not kind.accepts([{"Name": "x", "Kinds": ["a"]}]) and not kind.accepts([{"Name": "x"}])
    assert parse("int").accepts(3) and not parse("int").accepts(True) and parse("number").accepts(1) and not parse("bool").accepts(1)
    for bad in ("list[]", "list", "{a}", "date"):
        with pytest.raises(ValueError):
            parse(bad)


def test_templates(spark):
    t = Template("Hi {{ input.a.b }}{% for x in input.items %}, {{ x }}{% endfor %}{% if input.ok %}!{% else %}?{% endif %}")
    assert t.render(input={"a": {"b": 1}, "items": ["p", "q"], "ok": False}) == "Hi 1, p, q?"
    assert t.reads == {"a", "items", "ok"} and not t.plain
    assert Template("{% for r in inputs %}{{ r.x }}{% endfor %}").reads == frozenset()
    assert Template("{{ input }}").reads is None
    with pytest.raises(TemplateError):
        Template("{{ input.z }}").render(input={})
    for bad in ("{% for x in y %}", "{% while x %}", "{{ a + b }}"):
        with pytest.raises(TemplateError):
            Template(bad)
    df = spark.createDataFrame([(1, "x", None)], "a int, b string, c string")
    assert df.select(Template("{{ input.a }}-{{ input.b }}-{{ input.c }}").column()).first()[0] == "1-x-None"


def test_calls_retry_validate_and_glean():
    seen = []

    def answer(prompt):
        seen.append(prompt)
        return {"n": "x"} if len(seen) == 1 else {"n": len(seen)}

    call = Call(Hashed(answer), parse_schema({"n": "int"}), validate=[lambda o: o["n"] > 1])
    assert call.run("p") == (True, 2, {"n": 2})
    call = Call(Hashed(lambda p: {"n": p.count("Improve")}), parse_schema({"n": "int"}), gleaning=Gleaning(3, lambda o: (o["n"] == 0, "more")))
    assert call.run("p") == (True, 3 + 0 + 0, {"n": 1}) or call.run("p")[2] == {"n": 1}
    assert Call(Hashed(lambda p: {}), parse_schema({"n": "int"})).run("p")[:2] == (False, 3)


def test_map_with_client(spark):
    df = spark.createDataFrame([(i, f"text {i % 2}") for i in range(6)], "id int, text string")
    model = Hashed(lambda p: {"label": "even" if p.endswith("0") else "odd"})
    out = rows.map_rows(df, prompt="{{ input.text }}", output={"label": "enum[even, odd]"}, model=model)
    assert {(r.id, r.label) for r in out.collect()} == {(i, ["even", "odd"][i % 2]) for i in range(6)}
    half = rows.map_rows(df, prompt="{{ input.text }}", output={"label": "enum[even]"}, model=model)
    assert half.count() == 3 and rows.map_rows(df, prompt="{{ input.text }}", output={"label": "enum[even]"}, model=model, keep_failed=True).where("label is null").count() == 3


def test_filter_is_pushed_below_a_call(spark):
    df = spark.range(100).withColumn("text", F.lit("t"))
    out = rows.map_rows(df, prompt="{{ input.text }}", output={"label": "string"}, model=Hashed(), keep_failed=True).where("id < 5")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Filter")


def test_each_prompt_is_paid_for_once(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def answer(prompt):
        import uuid

        (log / uuid.uuid4().hex).write_text(prompt)
        return {"label": prompt.upper()}

    df = spark.createDataFrame([(i, f"t{i % 3}") for i in range(12)], "id int, text string")
    table = CallTable(str(tmp_path / "table"))
    run = lambda d: rows.map_rows(d, prompt="{{ input.text }}", output={"label": "string"}, model=Hashed(answer), calls=table)
    out = run(df)
    assert {(r.text, r.label) for r in out.collect()} == {(f"t{i}", f"T{i}") for i in range(3)} and out.count() == 12
    assert run(df).count() == 12 and len(list(log.iterdir())) == 3
    assert run(df.union(spark.createDataFrame([(99, "new")], df.schema))).count() == 13 and len(list(log.iterdir())) == 4


def test_expression_model(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abc")], "id int, text string")
    out = rows.filter_rows(df, output={"keep": "boolean", "_short_explanation": "string"}, model=Expressions({"keep": "length(text) > 2", "_short_explanation": "'long'"}))
    assert [tuple(r) for r in out.collect()] == [(2, "abc", "long")]
    with pytest.raises(ValueError):
        rows.filter_rows(df, output={"keep": "string"}, model=Expressions({"keep": "text"}))


def test_html_and_cutting(spark):
    assert absolute_links('<p><a href="x/y">t &amp; u</a></p>', "http://h/a/") == '<p><a href="http://h/a/x/y">t &amp; u</a></p>'
    assert to_markdown("<h1>T</h1><p>a <a href='u'>b</a></p><script>no</script><ul><li>i</li></ul>") == "# T\n\na [b](u)\n\n- i"
    got = spark.range(1).select(cut_middle(F.lit("abcdefghijklmnop"), 11)).first()[0]
    assert len(got) == 11 and got.startswith("abc") and got.endswith("nop")
