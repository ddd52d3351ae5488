"""Column-in, column-out building blocks: JVM expressions, and Arrow UDFs for matching tokens
(n-gram overlap, word alignment with stems, longest common subsequence)."""
