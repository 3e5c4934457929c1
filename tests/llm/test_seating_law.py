"""Numbers of tables of dishes with many customers, against a plain recursion."""

import numpy as np
import pytest

from keelson.llm import pitman_yor


def mean_tables(customers, new, d):
    """The weights of 1, 2, ... tables, new^t included, customer by customer."""
    weight, t = np.zeros(customers + 1), np.arange(customers + 1)
    weight[1] = new
    for n in range(1, customers):
        opened = np.concatenate([[0.0], weight[:-1]]) * new
        weight = weight * np.maximum(n - d * t, 0) + opened
        weight /= weight.sum()
    return (weight * t).sum()


@pytest.mark.parametrize("customers", [129, 500, 4096, 9000])
@pytest.mark.parametrize("new, d", [(50.0, 0.75), (5.0, 0.75), (5.0, 0.3)])
def test_tables_of_many_customers(customers, new, d):
    dishes = 1500
    seats = pitman_yor.Seats(np.full(dishes, customers), np.full(dishes, new), d, np.random.default_rng(8))
    seats.sweep()
    assert abs(seats.tables().mean() / mean_tables(customers, new, d) - 1) < 0.03


def test_weights_may_grow_between_draws():
    seats = pitman_yor.Seats(np.array([700, 300]), np.array([0.1, 0.1]), 0.8, np.random.default_rng(1))
    seats.set_weight(np.array([1e6, 1e6]))
    seats.sweep()
    assert (seats.tables() > [650, 270]).all()
