"""Operations over a corpus of canonical tables."""
