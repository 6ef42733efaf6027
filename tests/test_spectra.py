"""Eigenvalues against numpy, planted partitions from eigenvectors."""

import random

import numpy as np

from gneiss.operators import blocks, graphs, spectra


def planted(seed):
    rng, of = random.Random(seed), [n // 14 for n in range(42)]
    pairs = [(i, j) for i in range(42) for j in range(i) if rng.random() < (0.7 if of[i] == of[j] else 0.04)]
    return of, pairs


def test_eigenvalues_and_planted_blocks(spark):
    of, pairs = planted(1)
    df, truth = spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame(list(enumerate(of)), "node long, block long")
    a = np.zeros((42, 42))
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    d = 1 / np.sqrt(a.sum(axis=1))
    values, vectors = np.linalg.eigh(a * d[:, None] * d[None, :])
    got, found = spectra.eigenvectors(df, 3)
    assert np.abs(found - values[::-1][:3]).max() < 1e-5
    x = np.array([[r.x0, r.x1, r.x2] for r in got.orderBy("node").collect()])
    assert all(abs(abs(x[:, i] @ vectors[:, -1 - i]) - 1) < 1e-3 for i in range(3))
    assert blocks.nmi(graphs.spectral(df, 3), truth).first().nmi >= 0.95


def test_non_backtracking(spark):
    of, pairs = planted(2)
    df, truth = spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame(list(enumerate(of)), "node long, block long")
    arcs = [*pairs, *((j, i) for i, j in pairs)]
    b = np.array([[float(v == s and u != t) for s, t in arcs] for u, v in arcs])
    values = sorted(np.linalg.eigvals(b), key=lambda z: -abs(z))[:3]
    got, found = spectra.eigenvectors(df, 3, "non_backtracking")
    assert np.abs(found.real - np.real(values)).max() < 1e-3
    assert blocks.nmi(spectra.clustered(got, 3), truth).first().nmi >= 0.95


def test_a_part_sends_one_row_to_each_part(spark):
    """What is shuffled in a step has a row for each two parts; before, it had one for each node and part."""
    _, pairs = planted(3)
    df = spark.createDataFrame(pairs, "src long, dst long")
    static, n = spectra._routed(spectra.packed(spectra_near(df), 60))
    assert 3 < n < 30
    rows = static.collect()
    assert all(len(set(r.targets)) == len(r.targets) == len(r.sizes) <= n and sum(r.sizes) == len(r.picked) for r in rows)
    ends = {r.part: set(r.ends) for r in spectra.packed(spectra_near(df), 60).collect()}
    for r in rows:
        at = 0
        for target, size in zip(r.targets, r.sizes, strict=True):
            assert {r.own[i] for i in r.picked[at : at + size]} == ends[target] & set(r.own)
            at += size


def spectra_near(df):
    return graphs.neighbours(df)
