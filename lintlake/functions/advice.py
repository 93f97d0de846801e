"""What a finding of each rule means and what to do about it, by the rule's public id."""

from __future__ import annotations

ADVICE: dict[str, tuple[str, str]] = {
    "PY001": ("The clause also catches SystemExit and KeyboardInterrupt, and hides errors that nobody expected.", "Name the exceptions that can be handled here."),
    "PY002": ("The default is made once, when the function is defined, and shared by all calls.", "Default to None and make the object inside the function."),
    "PY003": ("Text becomes code that runs with all rights of the program.", "Parse the text: ast.literal_eval for literals, a table of functions for commands."),
    "PY004": ("Whoever can read the source has the secret, and it stays in the history.", "Read it from the environment or a secret store, and replace the one that leaked."),
    "PY005": ("Values put into the text of a statement can change what the statement does.", "Pass values as parameters of execute()."),
    "PY006": ("So many paths are hard to follow and to test.", "Split the code into smaller functions, or branch by a table."),
    "PY007": ("A function that no screen holds does too many things.", "Give its steps functions of their own."),
    "PY008": ("Each level adds a condition that a reader must keep in mind.", "Return early, or move inner levels into functions."),
    "PY009": ("Callers and type checkers can't tell what comes back.", "Add the return type after ->."),
    "PY010": ("Loading such data can run code that its author chose.", "Use JSON, or yaml.safe_load; verify a signature where objects must be loaded."),
    "PY011": ("A shell reads the composed text, so a value can add commands of its own.", "Call the program with a list of arguments and no shell."),
    "PY012": ("The generator is predictable: who sees a few values can work out the next.", "Use the module secrets."),
    "PY013": ("A document can name entities that make the parser read files or call addresses.", "Parse with defusedxml, or turn entities and network access off."),
    "PY014": ("A caller can make the server ask for addresses that only it can reach.", "Check the host against a list of allowed ones before the request."),
    "JS001": ("var is visible in the whole function and can be declared twice.", "Use const, or let where the value changes."),
    "JS002": ("Output for debugging reaches users' consoles and may tell too much.", "Remove it or use a logger with levels."),
    "JS003": ("Text that is set as HTML can bring scripts with it.", "Set textContent, or sanitise the HTML first."),
    "TS001": ("any switches the compiler's checks off for all that touches the value.", "Use the real type, or unknown with a test."),
    "JS004": ("Nested callbacks hide the order of steps and where errors go.", "Use async and await, or named functions."),
    "JS005": ("Either the token isn't verified as it should be, or a function is async for nothing.", "Verify tokens with a list of algorithms; drop async where nothing is awaited."),
    "JS006": ("A key like __proto__ changes what all objects have.", "Skip such keys, or merge into an object without prototype."),
    "TS002": ("The operator tells the compiler that a value is there without a test.", "Test the value, or use ?. and a default."),
    "GO001": ("The call's failure goes unnoticed.", "Take the error and return or handle it."),
    "GO002": ("A panic in a library ends its caller's program.", "Return an error."),
    "GO003": ("Nothing waits for the goroutine, nor ends it.", "Use a WaitGroup, an errgroup or a context."),
    "GO004": ("Values put into the text of a statement can change what the statement does.", "Use placeholders and arguments."),
    "GO005": ("A return or panic before Unlock leaves the lock held.", "Defer Unlock right after Lock."),
    "GO006": ("By convention callers find the context first.", "Make ctx the first parameter."),
    "GO007": ("The address can't be changed without a new build.", "Take it from settings."),
    "GO008": ("Without a receiver the send blocks for ever.", "Buffer the channel or start the receiver first."),
    "JA001": ("Output goes past the log's levels and targets.", "Use a logger."),
    "JA002": ("Without type parameters the compiler can't check what goes in.", "Give the element type."),
    "JA003": ("An exception before close() leaks the resource.", "Open it in the head of a try."),
    "JA004": ("Errors that nobody meant to handle are caught too.", "Catch the exceptions that can be handled."),
    "JA005": ("Values put into the text of a statement can change what the statement does.", "Use a PreparedStatement."),
    "JA006": ("The first call may give null, and the second fails on it.", "Test the result, or use Optional with map and orElse."),
    "RS001": ("The program panics where there is no value.", "Use ?, match or unwrap_or."),
    "RS002": ("The compiler doesn't check memory safety inside.", "Keep the block small and write down why it is sound, or do without."),
    "RS003": ("The place panics when it is reached.", "Write it, or return an error."),
    "RS004": ("Each clone copies; many point at unclear ownership.", "Borrow, or share by Rc or Arc."),
    "RS005": ("The message doesn't tell what was expected.", "Say what should have held and why."),
    "PERF001": ("The expression is compiled anew in each round.", "Compile it before the loop."),
    "PERF002": ("Each round copies all text so far.", "Collect the parts and join them at the end."),
    "PERF003": ("Collisions of MD5 and SHA-1 can be made.", "Use SHA-256, or for passwords bcrypt, scrypt or Argon2."),
    "PERF004": ("A path like ../ leaves the folder that was meant.", "Resolve the path and check that it lies below the folder."),
    "PERF005": ("Logs are read by more people than the data is meant for.", "Leave the value out or mask it."),
    "CL001": ("The note marks work that isn't done.", "Do it or track it elsewhere."),
    "CL002": ("A file of this size has many reasons to change.", "Split it by subject."),
    "CL003": ("The number's meaning isn't told where it stands.", "Give it a name."),
    "CL004": ("Whoever can read the source has the secret.", "Read it from the environment or a secret store."),
}
