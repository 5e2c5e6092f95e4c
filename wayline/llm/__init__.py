"""Operations on training corpora: each module is one operator with its own interface."""
