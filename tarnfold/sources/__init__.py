"""Where models come from: generators, and the tables of a star schema."""
