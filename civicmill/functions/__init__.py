"""Column -> Column helpers; everything here stays inside whole-stage codegen."""
