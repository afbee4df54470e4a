"""From text or ELM JSON to plans: a parser, a typing compiler, an engine for libraries."""
