from tessera.quality.checks import Test, TestResult, generate_tests, results_frame, run_test, run_tests

__all__ = ["Test", "TestResult", "generate_tests", "results_frame", "run_test", "run_tests"]
