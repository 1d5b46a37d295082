"""Secrets in capitals are personal data too, and stand for the same pseudonym."""

import re

from logloom.llm import pii


def test_upper_case_secrets(spark):
    value = "9233a8ec" * 4
    texts = [f"token = {value} end", f'TOKEN = "{value.upper()}" END', f"api_key: {value.upper()} x"]
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").orderBy("doc_id").collect()
    made = [re.search("[0-9a-fA-F]{32}", r.text).group() for r in rows]
    assert value not in [x.lower() for x in made]
    assert made[1] == made[2] == made[0].upper()
    assert rows[1].text == f'TOKEN = "{made[1]}" END'
