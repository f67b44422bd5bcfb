from quarry.operators import answer as an


def test_context_layout_and_fewer_than_three(spark):
    run = spark.createDataFrame([(1, 10, 1, "t10"), (1, 11, 2, "t11"), (2, 20, 1, "t20")],
                                "qid int, docno int, rank int, text string")
    c = {r.qid: r.context for r in an.context(run).collect()}
    assert c[1] == ("CONTEXT NUMBER: 1\nDOCUMENT ID: 1\n10\n\nt10\n\n"
                    "CONTEXT NUMBER: 2\nDOCUMENT ID: 2\n11\n\nt11\n\n")
    assert c[2] == "CONTEXT NUMBER: 1\nDOCUMENT ID: 1\n20\n\nt20\n\n"


def test_prompt_layouts_and_answers(spark):
    q = spark.createDataFrame([(1, "who?"), (2, "what?")], "qid int, query string")
    ctx = spark.createDataFrame([(1, "CONTEXT NUMBER: 1\nDOCUMENT ID: 1\n10\n\nbody\n\n")], "qid int, context string")
    p1 = {r.qid: r.messages for r in an.prompts_tool(q, ctx).collect()}
    assert [m.role for m in p1[1]] == ["system", "tool", "user"] and p1[1][2].content == "who?"
    assert p1[2][1].content == ""
    p2 = {r.qid: r.messages for r in an.prompts_user(q, ctx).collect()}
    assert [m.role for m in p2[1]] == ["system", "user"]
    assert p2[1][1].content.endswith("\n\nwho?")
    out = {r.qid: r.answer for r in an.final_answers(an.generate(an.prompts_tool(q, ctx)), ctx).collect()}
    assert out[1].startswith("body\n\nCONTEXT NUMBER: 1")
    assert out[2] == "\n\n"


def test_generate_passes_options(spark):
    seen = {}

    def fn(messages, temperature, max_tokens):
        seen["t"], seen["m"] = temperature, max_tokens
        return "x"
    q = spark.createDataFrame([(1, "q")], "qid int, query string")
    ctx = spark.createDataFrame([(1, "c")], "qid int, context string")
    r = an.generate(an.prompts_tool(q, ctx), fn).collect()
    assert r[0].answer == "x"
