"""Bundled grammars, in the notation of codeloom.llm.lr."""
