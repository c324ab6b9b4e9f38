import random

import numpy as np

from mentionlake.llm import toxicity


def test_scores_keep_the_odds_of_all_labels_where_the_sample_is_bounded(spark):
    rng = random.Random(5)
    rows = []
    for d in range(1650):
        toxic = int(d % 11 == 0)
        words = [rng.choice(["river", "table", "green", "morning", "paper"]) for _ in range(12)]
        if rng.random() < (0.6 if toxic else 0.2):
            words[rng.randrange(12)] = "vile"
        rows.append((d, " ".join(words), toxic))
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    models, curve = toxicity.train(data.select("doc_id", "text"), data.select("doc_id", "toxic"), sample=150)
    scores = [r.likely_toxic for r in toxicity.score(data.select("doc_id", "text"), models, curve).collect()]
    assert 0.04 < np.mean(scores) < 0.2  # 150 of 1,650 are toxic; half of the sample is
