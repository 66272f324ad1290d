"""Column expressions: no state, no job, all inside whole-stage code generation."""
