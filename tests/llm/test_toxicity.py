import random

from caseloom.llm import toxicity


def test_toxicity_tells_stems_by_their_share(spark, prose):
    """The stem has an ending of its own each time, so that no whole word repeats; clean texts have it once or not at all."""
    r = random.Random(4)
    ending = lambda: "".join(r.choices("abdefgiklmnorstu", k=6))
    texts = []
    for k in range(400):
        words = prose(k, 120).split()
        for at in r.sample(range(120), 5 if k % 4 == 0 else k % 2):
            words[at] = "achlich" + ending()
        texts.append((k, " ".join(words), "de"))
    df = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    model = toxicity.fit(df, spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id bigint, toxic int"))
    assert any(x.strip("^$") in "achlich" for x in model.picked)
    out = {row.doc_id: row for row in toxicity.scored(df.withColumn("held", toxicity.held_out(df.doc_id)).where("held"), model).collect()}
    assert {row.predicted for k, row in out.items() if k % 4 == 0} == {1} and {row.predicted for k, row in out.items() if k % 4} == {0}
    assert all(dict((k, t) for k, t, _ in texts)[k][s.start : s.end].startswith("achlich") for k, row in out.items() for s in row.spans)
