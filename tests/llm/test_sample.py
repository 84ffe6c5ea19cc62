"""The toxicity sample holds one text of each picked id, however often the id occurs."""

import numpy as np

from laborlens.llm import toxicity


def test_repeated_ids_are_one_text_of_the_fit(spark):
    docs = spark.createDataFrame([(i, f"{'vile' if i % 2 else 'kind'} word{i}") for i in range(40)]
                                 + [(7, f"vile number{j % 5}") for j in range(500)] + [(8, None)] * 9, "doc_id long, text string")
    grades = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, grade int")
    sample = toxicity.labelled(docs, grades, 30)
    assert sample.count() == sample.select("label_id").distinct().count() == 30
    assert toxicity.labelled(docs, grades, 40).count() == 40
    # a fit on all rows would see 7 some 500 times
    model, again = toxicity.train(docs, grades), toxicity.train(docs.dropDuplicates().repartition(7), grades)
    assert np.array_equal(model.words, again.words) and np.allclose(model.weights, again.weights)
    assert np.allclose(model.thresholds, again.thresholds)
