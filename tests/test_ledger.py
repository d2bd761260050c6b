"""Faults injected into a backend: what was answered is never asked again."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.inference import EchoBackend, Sampling, generate_resumable


class Faulty(EchoBackend):
    """Writes down what it is asked; raises for prompts with 'bad' and ends its process for 'fatal' while a file of that name exists."""

    def __init__(self, folder):
        self.folder = folder

    def generate(self, prompts, sampling):
        with open(f"{self.folder}/asked-{os.getpid()}", "a") as f:
            f.writelines(f"{p}\n" for p in prompts)
        for kind in ("bad", "fatal"):
            if any(kind in p for p in prompts) and os.path.exists(f"{self.folder}/{kind}"):
                if kind == "fatal":
                    os._exit(1)
                raise ValueError("no answer")
        return super().generate(prompts, sampling)


def asked(folder):
    out = [line for name in os.listdir(folder) if name.startswith("asked") for line in open(f"{folder}/{name}").read().splitlines()]
    for name in os.listdir(folder):
        if name.startswith("asked"):
            os.remove(f"{folder}/{name}")
    return out


def run(spark, prompts, folder, **more):
    df = spark.createDataFrame([(p,) for p in prompts], "p string")
    out = generate_resumable(df, "p", f"{folder}/ledger", lambda: Faulty(folder), Sampling(batch_size=1, retries=2), **more)
    return {r.prompt: r for r in out.collect()}


def test_failed_batches_are_asked_again_alone(spark, tmp_path):
    folder = str(tmp_path)
    open(f"{folder}/bad", "w").close()
    prompts = [f"p{i}" for i in range(20)] + ["bad1", "bad2", "", None, "p1"]
    got = run(spark, prompts, folder, passes=1)
    assert set(got) == {p for p in prompts if p is not None}
    assert all(r.candidates is None and r.error == "ValueError: no answer" if "bad" in p else r.candidates == [p] and r.error is None for p, r in got.items())
    said = asked(folder)
    assert sorted(said) == sorted([*{p for p in prompts if p is not None and "bad" not in p}, "bad1", "bad1", "bad2", "bad2"])  # retries
    os.remove(f"{folder}/bad")
    got = run(spark, [*prompts, "new"], folder)
    assert sorted(asked(folder)) == ["bad1", "bad2", "new"]
    assert all(r.candidates == [p] and r.error is None for p, r in got.items()) and len(got) == 24
    run(spark, prompts, folder)
    assert asked(folder) == []


def test_a_lost_worker_costs_its_wave_alone(spark, tmp_path):
    folder = str(tmp_path)
    open(f"{folder}/fatal", "w").close()
    prompts = [f"q{i}" for i in range(60)] + ["fatal"]
    with pytest.raises(Exception):
        run(spark, prompts, folder, wave=5)
    done = {r.request for r in spark.read.parquet(f"{folder}/ledger").where("candidates IS NOT NULL").collect()}
    first = asked(folder)
    os.remove(f"{folder}/fatal")
    got = run(spark, prompts, folder, wave=5)
    second = asked(folder)
    assert all(r.candidates == [p] for p, r in got.items()) and len(got) == 61
    assert len(second) == 61 - len(done) and len(first) + len(second) <= 61 + 5 * 4  # what is asked twice fits in one wave


def test_other_settings_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "p string")
    one = generate_resumable(df, "p", f"{tmp_path}/l", sampling=Sampling()).collect()
    two = generate_resumable(df, "p", f"{tmp_path}/l", sampling=Sampling(num_return_sequences=2)).collect()
    assert {tuple(r.candidates) for r in one} == {("a",), ("b",)} and {tuple(r.candidates) for r in two} == {("a", "a"), ("b", "b")}
    assert generate_resumable(df.where(F.lit(False)), "p", f"{tmp_path}/empty").count() == 0
