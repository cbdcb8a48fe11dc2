"""Operations on training text: search, formatting, packing, scoring, sharding, mixing and de-duplication."""
