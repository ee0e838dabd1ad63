"""Query shapes shared by the operators: long form, ranks, quantiles, one-row joins."""
