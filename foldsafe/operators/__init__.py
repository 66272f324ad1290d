"""Table operators: each takes DataFrames and returns DataFrames or a small fitted object."""
