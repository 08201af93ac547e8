"""How computations are planned: schemas, models, integrators and the executors that run them."""
