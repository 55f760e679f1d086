"""Calls of a model from Spark tasks: every question is answered once, whatever happens to the tasks, at a rate that all tasks share.

An answer is stored as soon as it is there, in a file of its own named by its question's key, and moved into place in one step. A task
asks only what the store does not have, so a task that is repeated after its executor was lost, or a whole job that is started again, repeats
no call but the one that was under way. ``audit`` is the two-phase review: an auditor names findings, a critic keeps or rejects them.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import judged


class Store:
    """Answers by key in a folder that all executors reach (a URI)."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        self.file_type = fs.FileType.NotFound

    def _place(self, key: str) -> str:
        name = hashlib.sha256(key.encode()).hexdigest()
        return f"{self.root}/{name[:2]}/{name}.json"

    def get(self, key: str) -> str | None:
        place = self._place(key)
        if self.fs.get_file_info(place).type == self.file_type:
            return None
        with self.fs.open_input_stream(place) as f:
            return json.loads(f.read())["answer"]

    def put(self, key: str, answer: str) -> None:
        place = self._place(key)
        self.fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
        temp = f"{place}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temp) as out:
            out.write(json.dumps({"key": key, "answer": answer}).encode())
        self.fs.move(temp, place)


def ask(questions: DataFrame, call: Callable[[str], str], store: str, callers: int = 3, calls: int = 10, period: float = 60.0, failures: int = 3) -> DataFrame:
    """key, answer of all questions (key, prompt); a null answer where the call failed or the breaker was open.

    At most ``callers`` calls run at a time, ``calls`` of them start in a ``period`` over all tasks together (each has its share), and a task stops asking
    after ``failures`` failures in a row until half a period is over. Questions that repeat a key are asked once.
    """
    share = max(1, calls // callers)

    def run(batches):
        answers, guard = Store(store), judged.Guard(failures=failures, rest=period / 2, calls=share, period=period, max_wait=10 * period, clock=time.time)
        for pdf in batches:
            said = []
            for key, prompt in zip(pdf["key"], pdf["prompt"], strict=True):
                got = answers.get(key)
                if got is None:
                    try:
                        got = guard(call, prompt)
                    except Exception:  # noqa: BLE001  a failed call is an absent answer
                        got = None
                    if got is not None:
                        answers.put(key, got)
                said.append(got)
            yield pd.DataFrame({"key": pdf["key"], "answer": said})

    once = questions.groupBy("key").agg(F.min("prompt").alias("prompt"))
    dealt = once.repartition(callers, "key")  # so many tasks, so many calls at a time
    return dealt.mapInPandas(run, "key string, answer string")


def batch_prompts(prompts: DataFrame, what: str) -> DataFrame:
    """key, prompt of numbered prompts (batch, prompt), such as those of models to classify; the key names what is asked and the text itself."""
    return prompts.select("batch", F.concat_ws(":", F.lit(what), F.sha2("prompt", 256)).alias("key"), "prompt")


def classify(prompts: DataFrame, call: Callable[[str], str], store: str, **limits) -> DataFrame:
    """batch, answer: the model's answers to the batches of models, each asked once (see ``privacy.prompts``)."""
    asked = batch_prompts(prompts, "classify")
    return asked.select("batch", "key").join(ask(asked, call, store, **limits), "key").select("batch", "answer")


def audit(files: DataFrame, rules: DataFrame, call: Callable[[str], str], store: str, tokens: int = 4000, **limits) -> DataFrame:
    """Findings of the auditor that the critic keeps: file_path, rule_id, line_start, line_end, message, confidence, name, severity, fix_hint.

    ``files``: file_path, content. ``rules``: pack_id, rule_id, name, severity, fix_hint, prompt. A file is shown with numbered lines, once for each pack, if it is
    within the budget of tokens. Both phases are asked by keys of pack, file content and phase, so a file that did not change is not
    asked again. Answers that are not JSON give nothing; findings of unknown rules go; lines are clamped to the file's.
    """
    some = judged.within_budget(files, tokens)
    lines = text.explode_lines(some.select("file_path", "content"), "content", "file_path")
    shown = text.numbered(lines, "file_path")
    packs = rules.groupBy("pack_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(": ", "rule_id", "prompt"))), "\n").alias("said"))
    pages = shown.join(F.broadcast(packs))  # every file is shown to each of a few packs
    first = pages.select("file_path", "pack_id", F.concat(F.lit("Find what breaks these rules:\n"), "said", F.lit("\n\n"), "file_path", F.lit("\n"), "numbered").alias("prompt"))
    key = lambda phase: F.concat_ws(":", F.lit(phase), "pack_id", F.sha2("prompt", 256))
    first = first.withColumn("key", key("auditor"))
    told = first.select("file_path", "pack_id", "key").join(ask(first, call, store, **limits), "key").drop("key")
    found = judged.parse(told, "answer", judged.ANSWER)
    candidates = found.join(F.broadcast(rules.select("pack_id", "rule_id")), ["pack_id", "rule_id"], "left_semi")
    listed = candidates.groupBy("file_path", "pack_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.to_json(F.struct("rule_id", "line_start", "message", "confidence")).alias("j")))), lambda x: x["j"]), "\n").alias("listed"))
    second = listed.join(shown, "file_path").select("file_path", "pack_id", F.concat(F.lit("Keep or reject each of these:\n"), "listed", F.lit("\n\n"), "file_path", F.lit("\n"), "numbered").alias("prompt"))
    second = second.withColumn("key", key("critic"))
    judged_ = second.select("file_path", "pack_id", "key").join(ask(second, call, store, **limits), "key").drop("key")
    reviewed = judged.parse(judged_, "answer", judged.REVIEW)
    kept = judged.critic_keeps(candidates, reviewed, ("file_path", "pack_id"))
    counts = lines.groupBy("file_path").agg(F.max("line_no").alias("n_lines"))
    out = judged.findings(kept, rules, counts)
    return judged.not_suppressed(out, lines).select("file_path", "rule_id", "line_start", "line_end", "message", "confidence", "name", "severity", "fix_hint")
